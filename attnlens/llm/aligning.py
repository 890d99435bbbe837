"""Alignment of two tokenizers' tokens over the same bytes.

Byte offsets where tokens of both sides end cut a text into groups; an A token and a B token whose byte ranges end together are a link, one at the end of
every group.  A stretch of bytes gives a *fragment*: open prefix (tokens up to its first common end), closed groups, open suffix (tokens behind the last).  Fragments form
a monoid: ``join`` aligns the left one's suffix with the right one's prefix, is associative, and the empty fragment is neutral.

Texts of at most ``chunk`` bytes are fragments of their own, folded from those of their words (both tokenizers part before a space that follows a
non-space and precedes a non-white character, so a word is a closed fragment; words in use are kept between texts).  Longer texts are dealt out as
byte ranges: each tokenizer's range ends at its own first safe place behind the range's end, so the two sides need not end together; each range becomes a fragment in some task, its closed groups
stay where they are, and only open ends travel up a tree of ``FAN`` fragments a node.  The rows of one text meet again, in order, for its digest alone.

Safe places: A between characters of unlike classes of its split pattern; B between two characters that stand side by side in none of its pieces.  A text without safe
places is one range.  Link counts of an id pair: both tokens end together, so the shorter one's bytes end the longer one's, and the two vocabularies bound the pairs: at most
(tokens of A x longest of A + pieces of B x longest of B), whatever the corpus; that table alone is broadcast.

Defined cases: texts that are null, empty or hold U+2581 (B reads it as a space, so the bytes differ) have no tokens; repeated rows are texts of their own and count in the links; an empty
table gives no rows; null ids stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import cut, give_back, sliced

CHUNK = 1 << 15
FAN = 8
#: Words whose fragments a task keeps; texts that go back together.
CACHE, ROWS = 300_000, 128
SPACE = "▁"
#: Before a space that parts words for both tokenizers.
_WORDS = regex.compile(r"(?<=[^ ]) (?=\S)")
_A_SAFE = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Sides:
    """Both tokenizers: ids and byte lengths of a stretch of text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        of = byte_level()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("merges of the byte-level vocabulary are not in the order of their ids")
        # entries behind the merges are special: as plain text they are never tokens of their own
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, t in self.a_bytes.items():
            self.a_len[i] = len(t)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        self.n_b = n
        if len(self.a_len) * n >= 1 << 31:
            raise ValueError("pairs of ids do not fit 31 bits")
        if any("\n" in p for p in pieces):
            raise ValueError("a piece holds a line feed")

    @cached_property
    def beside(self) -> set[str]:
        """Pairs of characters that stand side by side in a piece of B."""
        return {p[k : k + 2] for i in range(self.n_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
                for p in [self.b.id_to_piece(i).replace(SPACE, " ")] for k in range(len(p) - 1)}

    def a_safe(self, text: str, at: int) -> int:
        found = _A_SAFE.search(text, at) if at < len(text) else None
        return found.start() if found else len(text)

    def b_safe(self, text: str, at: int) -> int:
        while at < len(text) and text[at - 1 : at + 1] in self.beside:
            at += 1
        return at

    def a_ids(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_ordinary(text), np.int64)

    def b_ids(self, text: str) -> np.ndarray:
        """Tokens of ``text`` as it stands, in parts between safe places."""
        if not text:
            return _none()
        if text[0] == " " and len(text) > 1:
            return np.array(self.b.encode(text[1:]), np.int64)
        # the line feed is in no piece: it keeps the space apart that the tokenizer adds
        return np.array(self.b.encode("\n" + text)[2:], np.int64)


@lru_cache(1)
def sides_of(a_path: str, b_path: str) -> Sides:
    """The tokenizers, read once in a Python worker."""
    return Sides(a_path, b_path)


@lru_cache(1)
def groups_of(a_path: str, b_path: str) -> Groups:
    return Groups(sides_of(a_path, b_path))


@dataclass(frozen=True)
class Open:
    """Tokens of both sides, by id and by the byte offset of their end."""

    a: np.ndarray = field(default_factory=_none)
    a_ends: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_ends: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate(x) for x in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def __len__(self) -> int:
        return len(self.a) + len(self.b)


@dataclass(frozen=True)
class Fragment:
    """``prefix``: tokens up to the first common end; ``closed``: runs of whole groups in order; ``suffix``: tokens behind the last common end.

    ``met`` says whether there is a common end; if not, all tokens are in ``prefix``."""

    prefix: Open = field(default_factory=Open)
    closed: tuple[Open, ...] = ()
    suffix: Open = field(default_factory=Open)
    met: bool = False


def fragment(tokens: Open) -> Fragment:
    """The fragment of a run of tokens whose first group may begin before it."""
    common = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    if not len(common):
        return Fragment(tokens)
    i, j = np.searchsorted(tokens.a_ends, common[[0, -1]]) + 1, np.searchsorted(tokens.b_ends, common[[0, -1]]) + 1
    part = lambda a, b: Open(tokens.a[a], tokens.a_ends[a], tokens.b[b], tokens.b_ends[b])
    closed = part(slice(i[0], i[1]), slice(j[0], j[1]))
    return Fragment(part(slice(0, i[0]), slice(0, j[0])), (closed,) if len(closed) else (), part(slice(i[1], None), slice(j[1], None)), True)


def join(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches."""
    mid = fragment((left.suffix if left.met else left.prefix) + right.prefix)
    if not mid.met:  # then the right one has no common end either
        return Fragment(left.prefix, left.closed, mid.prefix, True) if left.met else mid
    closed = mid.closed + right.closed
    suffix = mid.suffix + right.suffix
    if left.met:
        return Fragment(left.prefix, (*left.closed, mid.prefix, *closed), suffix, True)
    return Fragment(mid.prefix, closed, suffix, True)


class Groups:
    """What whole groups come to: their words for the digest, and their links."""

    def __init__(self, sides: Sides) -> None:
        self.n_b = sides.n_b
        n = max(len(sides.a_len), sides.n_b)
        self.digits = np.frombuffer(b"".join(b"%010d" % i for i in range(n)), np.uint8).reshape(n, 10)
        self.blank = 10 - np.array([len(str(i)) for i in range(n)])

    def of(self, run: Open) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for each group, and the key A id x |B| + B id of each link."""
        last_a, last_b = np.isin(run.a_ends, run.b_ends, assume_unique=True), np.isin(run.b_ends, run.a_ends, assume_unique=True)
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        order = np.argsort(group, kind="stable")
        ids = np.concatenate([run.a, run.b])[order]
        sign = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])[order]
        text = np.empty((len(ids), 11), np.uint8)
        text[:, :10], text[:, 10] = self.digits[ids], sign
        return text[np.arange(11) >= self.blank[ids][:, None]].tobytes(), run.a[last_a] * self.n_b + run.b[last_b]


class Words:
    """Texts as folds of their words' fragments, which are closed."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.sides, self.groups = sides_of(a_path, b_path), groups_of(a_path, b_path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[bytes] = []
        self.n_a, self.n_b, self.keys = [], [], []

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        # joined words stay apart where each begins with one space and ends without
        joined = [w for w in new if w[1:2] not in ("", " ") and w[-1] != " " and not w[1].isspace()]
        for k in range(0, len(joined), 4000):
            self._add(joined[k : k + 4000])
        for word in set(new).difference(joined):
            self._add([word])

    def _add(self, words: list[str]) -> None:
        sides, whole = self.sides, "".join(words)
        a, b = sides.a_ids(whole), sides.b_ids(whole)
        a_ends, b_ends = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b])
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words])
        i, j = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
        if not (np.array_equal(a_ends[i - 1], ends) and np.array_equal(b_ends[j - 1], ends)):
            raise ValueError("a word is not a closed fragment")
        text, keys = self.groups.of(Open(a, a_ends, b, b_ends))
        n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
        n_links = np.diff(np.searchsorted(np.intersect1d(a_ends, b_ends, assume_unique=True), ends, "right"), prepend=0)
        # groups of a word: its part between semicolons
        stops = np.flatnonzero(np.frombuffer(text, np.uint8) == ord(";")) + 1
        cuts = [0, *stops[np.cumsum(n_links) - 1].tolist()]
        at = len(self.text)
        self.at.update(zip(words, range(at, at + len(words)), strict=True))
        self.text += [text[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        raw = keys.astype(np.int32).tobytes()
        marks = [0, *(4 * np.cumsum(n_links)).tolist()]
        self.keys += [raw[x:y] for x, y in zip(marks[:-1], marks[1:], strict=True)]
        self.n_a += n_a.tolist()
        self.n_b += n_b.tolist()

    def of(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
        """Numbers of A and B tokens, link keys, and the digest's words of each text."""
        split = [self.split(t) for t in texts]
        if len(self.at) > CACHE:
            self.clear()
        self._learn(chain.from_iterable(split))
        for words in split:
            at = list(map(self.at.__getitem__, words))
            keys = np.frombuffer(b"".join(map(self.keys.__getitem__, at)), np.int32)
            yield sum(map(self.n_a.__getitem__, at)), sum(map(self.n_b.__getitem__, at)), keys, b"".join(map(self.text.__getitem__, at))

    @staticmethod
    def split(text: str) -> list[str]:
        first, *rest = _WORDS.split(" " + text)
        return [first, *(" " + w for w in rest)]


_ROW = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary"


def _packed(keys: np.ndarray) -> bytes:
    """Distinct link keys, then how often each occurs."""
    return b"".join(x.astype(np.int32).tobytes() for x in np.unique(keys, return_counts=True))


def _unpacked(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pairs, np.int32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _merged(pairs: Iterable[bytes]) -> bytes:
    parts = list(map(_unpacked, pairs))
    if not parts:
        return b""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(place, np.concatenate([n for _, n in parts]), len(keys))
    return keys.astype(np.int32).tobytes() + n.astype(np.int32).tobytes()


def _short(docs: DataFrame, a_path: str, b_path: str, kind: str) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = Words(a_path, b_path)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                out = [(n_a, n_b, len(keys), hashlib.sha256(text[:-1]).hexdigest(), _packed(keys)) for n_a, n_b, keys, text in words.of(rows.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True))], _NAMES)

    return docs.mapInArrow(align, f"doc_id {kind}, {_ROW}")


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"]


def _ranges(docs: DataFrame, a_path: str, b_path: str, chunk: int, kind: str) -> DataFrame:
    """``doc_id, row, k, a_begin, a_text, b_begin, b_text``: byte ranges of `` `` and the text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(a_path, b_path)
        for batch in batches:
            for at in range(len(batch)):
                text = " " + batch.column(1)[at].as_py()
                marks, cuts = range(chunk, len(text), chunk), {}
                for name, safe in (("a", sides.a_safe), ("b", sides.b_safe)):
                    found = [0]
                    for m in marks:
                        found.append(safe(text, max(m, found[-1])))
                    cuts[name] = [*found, len(text)]
                begin, row = {"a": 0, "b": 0}, {x: [] for x in ("k", "a_begin", "a_text", "b_begin", "b_text")}
                for k in range(len(marks) + 1):
                    row["k"].append(k)
                    for x in "ab":
                        part = text[cuts[x][k] : cuts[x][k + 1]]
                        row[f"{x}_begin"].append(begin[x])
                        row[f"{x}_text"].append(part)
                        begin[x] += len(part.encode("utf-8", "surrogatepass"))
                n = len(row["k"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([at] * n)), batch.column(2).take(pa.array([at] * n)), *(pa.array(v, pa.string() if x.endswith("text") else pa.int64()) for x, v in row.items())],
                    ["doc_id", "row", *row])

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        deal, f"doc_id {kind}, row bigint, k bigint, a_begin bigint, a_text string, b_begin bigint, b_text string")


_OPEN = [f"{side}_{x}" for side in ("prefix", "suffix") for x in ("a", "a_ends", "b", "b_ends")]
#: A row is a fragment's open ends (``k`` set) or a run of whole groups (``k`` null, ``at`` its first end).
_FRAGMENT = ", ".join(f"{c} array<bigint>" for c in _OPEN) + ", met boolean, at bigint, n_a bigint, n_b bigint, n_groups bigint, words binary, pairs binary"


class _Rows:
    """Fragments as rows."""

    def __init__(self, kind: str, groups: Groups) -> None:
        self.groups = groups
        self.schema = f"doc_id {kind}, row bigint, k bigint, {_FRAGMENT}"

    @staticmethod
    def read(row: dict) -> Fragment:
        ends = [Open(*(np.array(row[f"{side}_{x}"], np.int64) for x in ("a", "a_ends", "b", "b_ends"))) for side in ("prefix", "suffix")]
        return Fragment(ends[0], (), ends[1], row["met"])

    def runs(self, closed: Iterable[Open]) -> Iterator[dict]:
        for run in closed:
            words, keys = self.groups.of(run)
            yield dict.fromkeys(_OPEN) | {"k": None, "met": None, "at": int(run.a_ends[0]), "n_a": len(run.a), "n_b": len(run.b), "n_groups": len(keys), "words": words, "pairs": _packed(keys)}

    def of(self, k: int, part: Fragment) -> list[dict]:
        ends = dict(zip(_OPEN, map(np.ndarray.tolist, part.prefix.parts() + part.suffix.parts()), strict=True))
        return [ends | {"k": k, "met": part.met, "at": None, "n_a": None, "n_b": None, "n_groups": None, "words": None, "pairs": None}, *self.runs(part.closed)]

    @staticmethod
    def batch(doc_id: pa.Array, row: pa.Array, rows: list[dict]) -> list[pa.Array]:
        kinds = {"met": pa.bool_(), "words": pa.binary(), "pairs": pa.binary()} | {c: pa.list_(pa.int64()) for c in _OPEN}
        names = ["k", *_OPEN, "met", "at", "n_a", "n_b", "n_groups", "words", "pairs"]
        return [doc_id, row, *(pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in names)], ["doc_id", "row", *names]


def _fragments(ranges: DataFrame, a_path: str, b_path: str, kind: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sides, rows = sides_of(a_path, b_path), _Rows(kind, groups_of(a_path, b_path))
        for batch in batches:
            for at in range(len(batch)):
                x = batch.slice(at, 1).to_pylist()[0]
                a, b = sides.a_ids(x["a_text"]), sides.b_ids(x["b_text"])
                out = rows.of(x["k"], fragment(Open(a, x["a_begin"] + np.cumsum(sides.a_len[a]), b, x["b_begin"] + np.cumsum(sides.b_len[b]))))
                again = pa.array([at] * len(out))
                yield pa.RecordBatch.from_arrays(*rows.batch(batch.column(0).take(again), batch.column(1).take(again), out))

    return ranges.repartition("row", "k").mapInArrow(read, _Rows(kind, None).schema)


def _up(ends: DataFrame, a_path: str, b_path: str, kind: str) -> DataFrame:
    """One level of the tree: FAN neighbouring fragments become one; groups that close on the way are rows too."""

    def fold(part: pa.Table) -> pa.Table:
        part, rows = part.drop_columns(["node"]).sort_by("k"), _Rows(kind, groups_of(a_path, b_path))
        whole = reduce(join, map(_Rows.read, part.drop_columns(["doc_id"]).to_pylist()))
        out = rows.of(part.column("k")[0].as_py() // FAN, whole)
        again = pa.array([0] * len(out))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(*rows.batch(part.column("doc_id").combine_chunks().take(again), part.column("row").combine_chunks().take(again), out))])

    return ends.withColumn("node", F.floor(F.col("k") / FAN)).groupBy("row", "node").applyInArrow(fold, _Rows(kind, None).schema)


def _long(docs: DataFrame, a_path: str, b_path: str, chunk: int, kind: str) -> DataFrame:
    """Texts beyond ``chunk`` bytes: a tree of fragments over Spark's tasks."""
    now = cut(_fragments(cut(_ranges(docs, a_path, b_path, chunk, kind)), a_path, b_path, kind))
    runs, ends = now.where("k is null"), now.where("k is not null")
    width = (ends.agg(F.max("k")).first()[0] or 0) + 1
    while width > 1:
        now = cut(_up(ends, a_path, b_path, kind))
        runs, ends = runs.unionByName(now.where("k is null")), now.where("k is not null")
        width = -(-width // FAN)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(kind, groups_of(a_path, b_path))
        for batch in batches:
            for at in range(len(batch)):
                whole = _Rows.read(batch.drop_columns(["doc_id"]).slice(at, 1).to_pylist()[0])
                if len(whole.suffix) or not whole.met:
                    raise ValueError("tokens of a text do not end together")
                out = list(rows.runs([whole.prefix]))  # a text begins at a common border, so its prefix is a group
                yield pa.RecordBatch.from_arrays(*rows.batch(batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), out))

    runs = runs.unionByName(ends.mapInArrow(close, _Rows(kind, None).schema))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of (row, at); one text's words stream through its digest."""
        now, done = None, []

        def ended() -> pa.RecordBatch:
            arrays = [pa.concat_arrays([d["doc_id"] for d in done]), *(pa.array([d[c] for d in done], t) for c, t in zip(_NAMES[1:], _TYPES, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, _NAMES)

        def finish() -> None:
            now["groups_sha256"], now["pairs"] = now.pop("sha").hexdigest(), _merged(now["pairs"])
            done.append(now)

        for batch in batches:
            for at in range(len(batch)):
                x = batch.drop_columns(["doc_id"]).slice(at, 1).to_pylist()[0]
                if now is None or now["row"] != x["row"]:
                    if now is not None:
                        finish()
                    now = {"row": x["row"], "doc_id": batch.column(0).slice(at, 1), "sha": hashlib.sha256(), "n_a": 0, "n_b": 0, "n_groups": 0, "pairs": []}
                else:
                    now["sha"].update(b";")
                now["sha"].update(x["words"][:-1])
                for c in ("n_a", "n_b", "n_groups"):
                    now[c] += x[c]
                now["pairs"].append(x["pairs"])
                if len(now["pairs"]) > FAN:
                    now["pairs"] = [_merged(now["pairs"])]
            if done:
                yield ended()
                done.clear()
        if now is not None:
            finish()
            yield ended()

    return runs.select("doc_id", "row", "at", "n_a", "n_b", "n_groups", "words", "pairs").repartition("row").sortWithinPartitions("row", "at").mapInArrow(digest, f"doc_id {kind}, {_ROW}")


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, pairs`` of every row; ``pairs`` packs the links by id pair."""
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    plain = (F.col("text") != "") & ~F.contains("text", F.lit(SPACE))
    none = base.where(~plain).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")], F.lit("").alias("groups_sha256"), F.lit(b"").alias("pairs"))
    long = F.octet_length("text") > chunk
    return _short(base.where(plain & ~long), a_path, b_path, kind).unionByName(_long(base.where(plain & long), a_path, b_path, chunk, kind)).unionByName(none)


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``a, b, n`` over the corpus; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = b""
        for batch in batches:
            for at in range(0, len(batch), 1000):
                total = _merged([total, *batch.column(0).slice(at, 1000).to_pylist()])
        keys, n = _unpacked(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    key = F.col("key")
    return aligned.select("pairs").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).select(
        F.floor(key / n_b).alias("a"), (key % n_b).alias("b"), "n")


def scored(aligned: DataFrame, n_b: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose count is their B id's highest) and ``count_sum``, counts being those of the whole corpus.

    The table of counts is broadcast; the vocabularies bound it (see above)."""
    counts = link_counts(aligned, n_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    table = counts.join(highest, "b").select((F.col("a") * n_b + F.col("b")).alias("key"), "n", (F.col("n") == F.col("most")).alias("best")).toArrow()
    order = np.argsort(table.column("key").to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("key", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, best = sent.value
        for batch in batches:
            out = []
            for pairs in sliced(batch.column(5)):
                key, n = _unpacked(pairs)
                at = np.searchsorted(keys, key)
                out.append((int(n.sum()), int(n[best[at]].sum()), int((n * counted[at]).sum())))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.int64()) for c in columns), batch.column(4)],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.select(*_NAMES).mapInArrow(
        score, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def links(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``align`` and ``scored``: texts are read and tokenized once."""
    import sentencepiece

    return scored(cut(align(docs, a_path, b_path, chunk, doc_id, text)), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
