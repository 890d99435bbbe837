"""MinHash near-dedup: one-permutation hashing with optimal densification.

A document's set is its distinct shingles of ``width`` words (the whole sequence if it has fewer
words).  One hash per shingle picks a bin and a value; each of the BANDS x ROWS bins keeps its smallest
value, and an empty bin copies the bin that a hash sequence of its own reaches first among the
non-empty ones.  ROWS bins in a row make one of BANDS bucket keys.

At a similarity of 0.8 two sets miss each other in every bucket with probability
(1 - 0.8^5)^40 = 1.2e-7.  Documents of equal sets are one class from the start.  In each bucket the class
with the smallest id is the centre, every other class is linked to one centre (the smallest over its
buckets), and links are confirmed on the full sets: at most one pair per class.  Buckets whose members are then in
different components are settled exactly, so no link is lost to the choice of centres.  Small ones are tested pair by pair.  In large ones
the members outside the bucket's main component (the strays) are tested against up to CENTRES new centres from it; strays that
are still apart are tested against all members of their buckets in blocks (``_settled``), and a block gives a spanning forest of what it finds.

Defined cases: null or word-less texts have an empty set, are linked with nothing and kept, as are rows with a null id; rows of one id
are one document, linked where one of its texts is; repeated rows and ties get equal results; empty tables give no rows; other columns
are ignored (``drop_near_duplicates`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import HOT_KEYS, cut, lean, sliced, small, space_words, split_join
from attnlens.llm.components import components

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: 100 * intersection >= PERCENT * union
PERCENT = 80
#: Ids of the classes under test are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Buckets of up to so many members test their open pairs one by one; larger ones try so many new centres first.
FEW, CENTRES = 8, 8
#: Sets and shingles of a block, and shingles of a slice of it.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1_000_000, 16_384
#: Parts of the pairs of one hot centre.
PARTS = 32
#: Words whose hashes a worker keeps.
CACHE = 200_000

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit mixer; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes; hashes of words are kept between texts."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = space_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        get, new = self.known.get, self._hash
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mixed(out * _MUL + h[k : len(h) - width + 1 + k])
        return np.unique(out)


#: Bins that an empty bin tries, in order; past them (never, in practice) it takes the next non-empty one.
TRIES = 4096
_SEQUENCE = (_mixed(np.arange(BINS * TRIES, dtype=np.uint64) * _MUL + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, TRIES)
_WEIGHTS = _mixed(np.arange(1, BINS + 1, dtype=np.uint64) * _MUL) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bins(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty set."""
    h = _mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    out = np.full(BINS, _EMPTY)
    np.minimum.at(out, ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64), h << np.uint64(32) | h >> np.uint64(32))
    full = out != _EMPTY
    if full.all():
        return out
    source = out.copy()
    todo, at = np.flatnonzero(~full), 0
    while len(todo) and at < TRIES:
        step = max(8, min(TRIES - at, 4 * BINS // max(1, int(full.sum()))))
        tries = _SEQUENCE[todo, at : at + step]
        hit = full[tries]
        found = hit.any(1)
        out[todo[found]] = source[tries[found, hit[found].argmax(1)]]
        todo, at = todo[~found], at + step
    out[todo] = source[np.flatnonzero(full)[0]]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    mixed = _mixed(signature * _MUL + _WEIGHTS).reshape(BANDS, ROWS)
    return _mixed(mixed.sum(1, dtype=np.uint64) + _WEIGHTS[:BANDS]).view(np.int64)


def signatures(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set) and ``bands`` (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for value in sliced(batch.column(1)):
                s = shingler(value)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(bins(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lean(sign), f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """``node, flag, shingles`` of the documents whose ids are in ``wanted`` (node, flag), dealt by ``node``; equal sets of one id once."""
    ids = wanted.select(F.col("node").alias("doc_id"), "flag")
    ids = F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id").select("doc_id", "flag", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler(v) for v in sliced(batch.column(2))]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)].astype(np.int32)
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             ["node", "flag", "digest", "shingles"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (picked.mapInArrow(lean(shingle), f"node {kind}, flag int, digest binary, shingles array<bigint>")
            .repartition("node").dropDuplicates(["node", "digest"]).drop("digest"))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  The pairs of a hot ``b`` are dealt over PARTS copies of its set."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("flag")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(2).alias("flag")))
    sets = _sets(docs, cut(ends.groupBy("node").agg(F.bit_or("flag").alias("flag"))), width, doc_id, text)
    limit = pairs.count() // HOT_KEYS
    hot = F.broadcast(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("b", F.lit(PARTS).alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.lit(PARTS))).cast("int")
    left = sets.where("flag != 2").select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = (sets.where("flag != 1").select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(hot, "b", "left")
             .select("b", "y", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(hot, "b", "left").select("a", "b", part.alias("part")).join(right, ["b", "part"]).join(left, "a")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``kept`` for every row of ``docs``."""
    signed = cut(signatures(docs, width, doc_id, text))
    classes = (signed.where("digest is not null and doc_id is not null").groupBy("digest")
               .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"), F.count(F.lit(1)).alias("copies")))
    classes = cut(classes.select("digest", "first.*", "copies"))
    rows = classes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value"))
    rows = rows.select("node", "n", F.xxhash64("band", "value").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = cut(split_join(rows, shared, "bucket", "members", classes.count() * BANDS))
    n_members = members.count()
    heads = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("size"), F.count(F.lit(1)).alias("all"))
    alike = lambda n, m: f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"
    pairs = split_join(members, heads, "bucket", "all", n_members).where("node != centre").where(alike("n", "size")).groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b"))
    merged = components(confirmed(cut(pairs), docs, width, percent, doc_id, text))
    open_ = _apart(members.select("bucket", "node", "n"), merged, n_members)
    few = open_.where(F.col("members") <= FEW).drop("members")
    other = few.select("bucket", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    pairs = few.join(other, "bucket").where("node > b and component != other").where(alike("n", "m")).select(F.col("node").alias("a"), "b")
    large = open_.where(F.col("members") > FEW)
    near = _with_main(large, n_members).where("component != main").where(alike("n", "size")).groupBy(F.col("node").alias("a")).agg(F.collect_set("centre").alias("to"))
    pairs = cut(pairs.unionByName(near.select("a", F.explode(F.slice(F.array_sort("to"), 1, CENTRES)).alias("b"))).distinct())
    if pairs.limit(1).count():
        joined = lambda links: components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        merged = joined(confirmed(pairs, docs, width, percent, doc_id, text))
        apart = _apart(large.select("bucket", "node", "n"), merged, n_members)
        if apart.limit(1).count():
            merged = joined(_settled(_with_main(apart, n_members), docs, width, percent, doc_id, text))
    labels = classes.join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left").where("copies > 1 or component is not null")
    labels = labels.select("digest", "copies", F.coalesce("component", "doc_id").alias("component"))
    sets = signed.where("digest is not null")
    found = split_join(sets, labels, "digest", "copies", signed.count(), "left").select("doc_id", "n_shingles", "component")
    found = found.unionByName(signed.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast(docs.schema[doc_id].dataType).alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def _apart(members: DataFrame, merged: DataFrame, total: int) -> DataFrame:
    """The ``members`` (bucket, node, n) of buckets with more than one component, with ``component`` and the bucket's number of ``members``."""
    rows = members.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
             .where("low != high").select("bucket", "members"))
    return cut(split_join(rows, mixed, "bucket", "members", total))


def _with_main(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` of ``_apart`` with their bucket's ``main``, the largest component in it, and a ``centre`` of ``size`` shingles drawn from that."""
    drawn = F.xxhash64("node", "bucket")
    parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by("node", drawn).alias("centre"), F.min_by("n", drawn).alias("size"))
    largest = parts.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component", "centre", "size")).alias("top"))
    return split_join(rows, largest.select("bucket", "all", F.col("top.component").alias("main"), "top.centre", "top.size"), "bucket", "all", total)


def _settled(apart: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links across components inside the buckets of ``apart`` (of ``_with_main``).

    Buckets of one main component go together.  Their strays are tested against all their members, block against block of
    bounded size, so no task holds a component and no pair is a row: a block gives at most one link less than it has sets.
    """
    nodes = cut(apart.select("main", "node", "n", "component").distinct())
    stray = F.col("component") != F.col("main")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    sizes = nodes.groupBy("main").agg(parts(F.count(F.lit(1)), F.sum("n")).alias("blocks"), F.count(F.lit(1)).alias("nodes"),
                                      parts(F.sum(stray.cast("long")), F.sum(F.when(stray, F.col("n")).otherwise(0))).alias("stray_blocks"))
    dealt = split_join(nodes, sizes, "main", "nodes", nodes.count()).drop("nodes", "n")
    dealt = dealt.join(_sets(docs, nodes.select("node", F.lit(0).alias("flag")).distinct(), width, doc_id, text), "node")
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    at_stray = F.pmod(F.xxhash64("node", F.lit(1)), F.col("stray_blocks")).cast("int")
    columns = ["main", "node", "component", "shingles"]
    whole = dealt.select(*columns, at.alias("block"), F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("stray_block"), F.lit(False).alias("stray"))
    strays = dealt.where(stray).select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), at_stray.alias("stray_block"), F.lit(True).alias("stray"))
    kind = apart.schema["node"].dataType.simpleString()

    def links(part: pa.Table) -> pa.Table:
        stray = part.column("stray").to_numpy(zero_copy_only=False)
        node = part.column("node").to_numpy()
        component = np.unique(part.column("component").to_numpy(), return_inverse=True)[1]
        lists = part.column("shingles").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
        both = _shared(flat, sizes, x, y)
        near = 100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)
        i, j = np.nonzero(near & (component[x][:, None] != component[y][None, :]))
        keep = spanning(component[x[i]], component[y[j]])
        return pa.table({"a": node[x[i[keep]]], "b": node[y[j[keep]]]})

    return whole.unionByName(strays).groupBy("main", "block", "stray_block").applyInArrow(links, f"a {kind}, b {kind}")


def _shared(flat: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of elements that set x[i] and set y[j] have in common; the sets of ``sizes`` elements lie end to end in ``flat``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    row_of, of_x = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    row_of[x], row_of[y], of_x[x] = np.arange(len(x)), np.arange(len(y)), True
    column = np.unique(flat[of_x[owner]])  # what no x has cannot be shared with one
    place = np.minimum(np.searchsorted(column, flat), max(0, len(column) - 1))
    held = column[place] == flat if len(column) else np.zeros(len(flat), bool)
    both = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(column), COLUMNS):
        use = held & (place >= low) & (place < low + COLUMNS)
        a = np.zeros((len(x), min(COLUMNS, len(column) - low)), np.float32)
        b = np.zeros((len(y), a.shape[1]), np.float32)
        for rows, of in ((a, use & of_x[owner]), (b, use & ~of_x[owner])):
            rows[row_of[owner[of]], place[of] - low] = 1
        both += a @ b.T
    return both


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links a[k] - b[k] that connect all that the links connect, none more than needed."""
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := above.get(v, v)) != v:
            above[v] = v = above.get(up, up)
        return v

    out = []
    _, first = np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b), return_index=True)
    for k in first.tolist():
        u, v = root(int(a[k])), root(int(b[k]))
        if u != v:
            above[u] = v
            out.append(k)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are not the smallest id of their component; of several rows with that id one stays, the smallest by a hash of
    its columns.  Rows with a null id stay; so do all columns."""
    near = cut(near_duplicates(docs, width, percent, doc_id, text))
    gone = near.where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    left = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    again = cut(near.where("kept and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(doc_id))
    if small(again, 0):
        return left
    one = left.join(again, doc_id, "left_semi").groupBy(doc_id).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one")).select("one.*")
    return left.join(again, doc_id, "left_anti").select(*docs.columns).unionByName(one)
