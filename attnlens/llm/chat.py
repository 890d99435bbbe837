"""Chat formatting as a prefix tree.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles and texts are escaped: every ``<|``, ``<\\|``, ``<\\\\|``... gets one more
backslash, so no ``<|`` is left, and ``plain`` takes it away again; in roles a backslash and a line feed are written ``\\\\`` and ``\\n`` first.

Conversations that share their first turns share nodes of a tree, one tree for each first turn.  A node is the chain hash of its turns (BLAKE2, 128 bits).
``tree`` emits every node once: tokens of header, text and end, ``start`` (its place in the tree's token sequence, depth first), ``position`` (its first position id: tokens of
its ancestors) and ``attend`` (the intervals of the sequence that hold its ancestors, neighbours merged; inside itself a node is causal).  Conversations are read back from there.

Depth-first order: conversations are sorted by the hashes of those of their nodes that have siblings, which keeps the conversations of a subtree together; a node belongs to the first
conversation that has it, and nodes in the order (conversation, depth) are the depth-first order.  Ranks and token offsets are taken in ranges, so a tree of a third of all conversations is
spread over tasks; a node that a third of all conversations share is one row and meets them by ``split_join``.  One conversation's turns pass one task in order, a few at a time, as its digest asks.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text is empty; repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnlens.llm.common import HOT_KEYS, cut, split_join

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
ROWS = 256
#: Characters that are tokenized together.
PART = 1 << 15
_BAR, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _BAR.sub(r"<\\\1|", text)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def role_in(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain(role))


class Tokens:
    """Byte-level tokens, and two more ids for the control strings."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start = self.encoding.n_vocab + 1  # the next id is some vocabularies' end of text
        self.end = self.start + 1

    def of(self, text: str) -> list[int]:
        return [i for at in range(0, len(text), PART) for i in self.encoding.encode_ordinary(text[at : at + PART])]

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Tokens of a turn, and the place and number of its text's."""
        head, body = [self.start, *self.of(role_in(role) + "\n")], self.of(escaped(text))
        return [*head, *body, self.end, *self.of("\n")], len(head), len(body)

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def read(self, ids: list[int], at: int, n: int) -> tuple[str, str]:
        """Role and text, both still escaped, of a turn's tokens."""
        head, tail = self.text(ids[1:at]), self.text(ids[at + n + 1 :])
        if ids[0] != self.start or ids[at + n] != self.end or head[-1:] != "\n" or tail != "\n":
            raise ValueError("tokens are no turn of the template")
        return head[:-1], self.text(ids[at : at + n])


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, k, node, parent, role, text``: every turn with the chain hash of all turns up to it."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, k = (None,), b"", 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, out = batch.slice(at, ROWS), ([], [], [])
                for c, r, t in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if conv != (c,) or not k:
                        conv, node, k = (c,), b"", 0
                    head = r.encode("utf-8", "surrogatepass")
                    body = hashlib.blake2b(b"%d:" % len(head) + head + t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    out[1].append(node)
                    node, k = hashlib.blake2b(node + body, digest_size=16).digest(), k + 1
                    out[0].append(k)
                    out[2].append(node)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[1], pa.binary()), part.column(2), part.column(3)],
                                                 ["conv", "k", "node", "parent", "role", "text"])

    kind = rows.schema[conv_id].dataType.simpleString()
    one = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return one.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(
        chain, f"conv {kind}, k bigint, node binary, parent binary, role string, text string")


def _ranked(chained: DataFrame, total: int) -> DataFrame:
    """``conv, tree, rank, part``: conversations in the depth-first order of their trees; ``part`` is the range a rank is in.  ``total``: the number of turns."""
    later = chained.where("k > 1").select("parent", "node", "conv", "k")
    branching = cut(later.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("members"))
                    .where("kids > 1").select("parent", "members"))
    key = split_join(later, branching, "parent", "members", total).groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("path"))
    whole = chained.groupBy("conv").agg(F.max(F.when(F.col("k") == 1, F.col("node"))).alias("tree"), F.max("k").alias("n"))
    path = whole.join(key.withColumnRenamed("conv", "c"), F.col("c").eqNullSafe(F.col("conv")), "left").select("conv", "tree", "n", F.coalesce("path", F.array().cast("array<binary>")).alias("path"))
    order = ["tree", "path", "n", "conv"]
    return path.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "tree", F.monotonically_increasing_id().alias("rank"), F.spark_partition_id().alias("part"))


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_NODE = "node binary, tree binary, k bigint, rank bigint, part int, members bigint"
_TREE = ["node", "members", "tree", "k", "start", "position", "attend", "n_tokens", "text_at", "text_n", "trained", "tokens"]


def _tokenized(owned: DataFrame, tokenizer: str) -> DataFrame:
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokens(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                roles = rows.column(6).to_pylist()
                out = [of.turn(r, t) for r, t in zip(roles, rows.column(7).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:6], *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2)), pa.array([r == TRAINED for r in roles]),
                     pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([len(o[0]) for o in out], pa.int64())],
                    [*rows.schema.names[:6], "text_at", "text_n", "trained", "tokens", "n_tokens"])

    return owned.mapInArrow(tokenize, f"{_NODE}, text_at bigint, text_n bigint, trained boolean, tokens array<int>, n_tokens bigint")


def _attended(paths: DataFrame) -> DataFrame:
    """``node, start, position, attend`` of every node, from the turns of the conversation that owns it."""

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (rank, k): merged intervals of the turns so far."""
        now, spans, position = None, [], 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows, spent, seen, keep = batch.slice(at, ROWS), [], [], []
                for rank, owner, start, n in zip(*(rows.column(i).to_pylist() for i in (0, 2, 4, 5)), strict=True):
                    if rank != now:
                        now, spans, position = rank, [], 0
                    keep.append(rank == owner)
                    seen.append([{"begin": a, "end": b} for a, b in spans] if rank == owner else None)
                    spent.append(position)
                    position += n
                    spans = spread(spans, start, n)
                yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), pa.array(spent, pa.int64()), pa.array(seen, _SPANS)], ["node", "start", "position", "attend"]).filter(pa.array(keep, pa.bool_()))

    return paths.select("rank", "k", "owner", "node", "start", "n_tokens").repartition("rank").sortWithinPartitions("rank", "k").mapInArrow(
        attend, "node binary, start bigint, position bigint, attend array<struct<begin: bigint, end: bigint>>")


def spread(spans: list[tuple[int, int]], start: int, n: int) -> list[tuple[int, int]]:
    """Intervals and one more; neighbours are merged."""
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], start + n)]
    return [*spans, (start, start + n)]


def tree(rows: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The nodes (``tree, start, position, attend, tokens`` ...; tokens ``text_at`` to ``text_at + text_n`` of a ``trained`` node are under the loss mask), and the
    turns ``conv, rank, k, node, members`` that point at them."""
    chained = cut(turns(rows, conv_id, turn, role, text))
    total = chained.count()
    rank = cut(_ranked(chained, total))
    same = lambda x: F.col("c").eqNullSafe(F.col("conv")) & (F.col("j") == F.col("k")) if x else F.col("c").eqNullSafe(F.col("conv"))
    # which conversation owns a node is settled by hashes; texts move once
    held = cut(chained.select("conv", "k", "node").join(rank.withColumnRenamed("conv", "c"), same(False)).drop("c"))
    first = held.groupBy("node").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("members"))
    owned = held.join(first, ["node", "rank"]).select("node", "tree", F.col("k").alias("j"), "rank", "part", "members", F.col("conv").alias("c"))
    nodes = cut(_tokenized(chained.select("conv", "k", "role", "text").join(owned, same(True)).select("node", "tree", "k", "rank", "part", "members", "role", "text"), tokenizer))
    # places in a tree: sums of its ranges, then running sums inside one range
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("tree", "part").orderBy("rank", "k").rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy("tree", "part").agg(F.sum("n_tokens").alias("n")).select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = (nodes.select("node", "members", "tree", "part", "rank", "k", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .join(sums, ["tree", "part"]).select("node", "members", F.col("rank").alias("owner"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens"))
    paths = cut(split_join(held.select("conv", "rank", "k", "node"), cut(placed), "node", "members", total))
    return nodes.drop("rank", "part").join(_attended(paths), "node").select(*_TREE), paths.select("conv", "rank", "k", "node", "members")


_READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every conversation, from tokens, masks, positions and intervals alone.

    A node whose position or intervals are not those of the turns before it is an error.  Nodes that many conversations share are dealt out in as many copies as keep each key small."""
    limit = paths.count() // HOT_KEYS + 1
    copies = F.floor(F.col("members") / limit)
    left = paths.withColumn("copy", F.pmod(F.xxhash64("rank", "k"), copies + 1))
    right = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("members", "k", "tree")
    kind = paths.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, done = Tokens(tokenizer), None, []

        def ended() -> pa.RecordBatch:
            counts = [[d["n"] for d in done], [d["turns"].hexdigest() for d in done], [d["chars"] for d in done], [d["loss"].hexdigest() for d in done], [d["size"] for d in done]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([d["conv"] for d in done]), *map(pa.array, counts, kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                for i, x in enumerate(rows.drop_columns(["conv"]).to_pylist()):
                    if now is None or now["rank"] != x["rank"]:
                        if now is not None:
                            done.append(now)
                        now = {"rank": x["rank"], "conv": rows.column(0).slice(i, 1), "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "tokens": 0, "spans": []}
                    if x["position"] != now["tokens"] or [(s["begin"], s["end"]) for s in x["attend"]] != now["spans"]:
                        raise ValueError("a node does not follow its ancestors")
                    role, text = of.read(x["tokens"], x["text_at"], x["text_n"])
                    now["n"] += 1
                    now["tokens"] += len(x["tokens"])
                    now["spans"] = spread(now["spans"], x["start"], len(x["tokens"]))
                    now["size"] += len(START) + len(role) + 1 + len(text) + len(END) + 1
                    now["turns"].update(f"{role_out(role)}\n{plain(text)}\n".encode("utf-8", "surrogatepass"))
                    if x["trained"]:
                        now["chars"] += len(plain(text))
                        now["loss"].update(plain(text).encode("utf-8", "surrogatepass"))
                if done:
                    yield ended()
                    done.clear()
        if now is not None:
            done.append(now)
            yield ended()

    columns = ["conv", "rank", "k", "start", "position", "attend", "text_at", "text_n", "trained", "tokens"]
    return left.join(right, ["node", "copy"]).select(*columns).repartition("rank").sortWithinPartitions("rank", "k").mapInArrow(read, f"conv_id {kind}, {_READ}")
