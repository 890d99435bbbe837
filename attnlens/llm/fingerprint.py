"""Document fingerprints: a threshold-scaled sketch.

A text's shingles (``width`` words in a row; of fewer words, the whole sequence) are hashed to 64
bits, and every hash below a fixed fraction of the range is kept: the sketch of a union of shingle sets is the union of their sketches, and
|A and B| / |A| of sketches estimates containment without bias even where one text is far longer.  A text whose sketch would
be empty has its smallest hash in its place, so that texts with words tell each other apart; that hash is no part of a union's sketch
unless the union's would be empty too.

Only column expressions run: one array of word hashes per text, combined over ``width`` places.
The successor of a document (ascending id) is found inside blocks of ids; the first row of each block is
sent once more to the block before it.  Blocks are cut at quantiles of the ids, so outlying or clustered ids do not fill one, and
an id with the rows of several blocks is dealt over them by its texts.  At most ``max_blocks`` blocks are made, so the table of
their first rows that is broadcast has a fixed size limit; beyond ``max_blocks`` x ``rows_per_block`` rows the blocks grow and are sorted on disk
where they do not fit.

Defined cases: a null text counts as empty; null ids come first; an empty text has the empty fingerprint ``0:`` and
likeness 0 to everything but another empty text (1); ties of the id are ordered by the text's hash; the row after the
last is the first; a single row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: one hash in SCALE is kept
SCALE = 4
ROWS_PER_BLOCK = 512
MAX_BLOCKS = 8_192
#: Stands for a null id, before all others.
NULL_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, not once for each element that refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """The sorted array of kept shingle hashes."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return _bound(hashes, lambda h: _bound(_shingles(h, width), lambda s: _kept(s, scale)))


def _shingles(hashes: Column, width: int) -> Column:
    whole = F.array(F.xxhash64(hashes))
    many = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)),
                       lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) < width, whole).otherwise(many)


def _kept(hashes: Column, scale: int) -> Column:
    limit = -(1 << 63) + (1 << 64) // scale
    smallest = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    below = F.filter(hashes, lambda h: h < F.lit(limit))
    return F.sort_array(F.array_distinct(F.when(F.size(below) == 0, smallest).otherwise(below)))


def rendered(sketch_: Column) -> Column:
    """A sketch as text: its size, then each hash in hexadecimal."""
    return F.concat(F.size(sketch_).cast("string"), F.lit(":"),
                    F.array_join(F.transform(sketch_, lambda h: F.lower(F.hex(h))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a`` that ``b`` holds, 0 to 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _below(cuts: Column, count: int, value: Column, strictly: bool) -> Column:
    """How many of the ``count`` sorted ``cuts`` are at most (below, if ``strictly``) ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(count.bit_length() - 1, -1, -1)])
    at = lambda p, s: F.get(cuts, p + s - 1)
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(at(p, s) < value if strictly else at(p, s) <= value, p + s).otherwise(p))


def _blocks(docs: DataFrame, ident: Column, tie: Column, blocks: int) -> Column:
    """The block of each row: as many as ``blocks`` (at least 1), in the order of ``ident`` and ``tie``."""
    found = docs.agg(F.percentile_approx(ident, [k / blocks for k in range(1, blocks)], 16 * blocks).alias("cuts")).first()["cuts"] if blocks > 1 else []
    if not found:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")
    low, high = _below(cuts, len(found), ident, True), _below(cuts, len(found), ident, False)
    share = tie.cast("double") / float(1 << 64) + 0.5
    # an id that is several cuts has as many blocks, shared out by its texts
    return F.when(high == low, low).otherwise(low + 1 + F.least(F.floor(share * (high - low)), high - low - 1)).cast("int")


def with_next(docs: DataFrame, doc_id: str, columns: list[str], prepare=lambda df: df, max_blocks: int = MAX_BLOCKS,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``prepare(docs)`` with a struct ``_next`` of ``columns`` of the row after each, ascending ``doc_id``.
    ``prepare`` adds columns once the rows to work on are known."""
    ident, tie = F.coalesce(F.col(doc_id), F.lit(NULL_ID)), F.xxhash64(*[c for c in columns if c in docs.columns])
    n = docs.count()
    if not n:
        return prepare(docs).withColumn("_next", F.struct(*columns))
    block = _blocks(docs, ident, tie, max(1, min(max_blocks, n // rows_per_block)))
    keyed = docs.withColumn("_id", ident).withColumn("_tie", tie).withColumn("_block", block)
    # the block before each, circularly; at most max_blocks rows, so one window partition is bounded
    firsts = (keyed.groupBy("_block").agg(F.min(F.struct("_id", "_tie")).alias("_first")).withColumn("_one", F.lit(1)))
    order = Window.partitionBy("_one").orderBy("_block")
    last = Window.partitionBy("_one")
    firsts = firsts.select("_block", "_first", F.coalesce(F.lag("_block").over(order), F.max("_block").over(last)).alias("_into"))
    sent = (keyed.join(F.broadcast(firsts), "_block").where((F.col("_id") == F.col("_first._id")) & (F.col("_tie") == F.col("_first._tie")))
            .withColumn("_block", F.col("_into")).drop("_first", "_into").withColumn("_sent", F.lit(1)))
    both = prepare(keyed.withColumn("_sent", F.lit(0)).unionByName(sent))
    inside = Window.partitionBy("_block").orderBy("_sent", "_id", "_tie")
    return (both.withColumn("_next", F.lead(F.struct(*columns)).over(inside)).where("_sent = 0")
            .drop("_id", "_block", "_sent", "_tie"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                 scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of its characters replaced
    by as many (or all) of the first characters of the next document; with both likenesses, and how much of the text those two hold."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))

    def prepare(df: DataFrame) -> DataFrame:
        return (df.withColumn("n_chars", F.char_length("body").cast("long"))
                .withColumn("sk", sketch(F.col("body"), width, scale)))

    paired = with_next(base, "doc_id", ["body", "sk"], prepare)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), F.col("n_chars").cast("int") - quarter),
                      F.substring(F.col("_next.body"), F.lit(1), quarter))
    paired = paired.select("doc_id", "n_chars", "sk", F.col("_next.sk").alias("next_sk"), edited.alias("edited"))
    paired = paired.withColumn("edited_sk", sketch(F.col("edited"), width, scale))
    return paired.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), rendered(F.col("sk")).alias("fingerprint"),
        rendered(F.col("edited_sk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"), containment(F.col("sk"), F.col("edited_sk")).alias("held_by_edited"),
        containment(F.col("sk"), F.col("next_sk")).alias("held_by_next"))
