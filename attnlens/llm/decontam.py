"""Benchmark decontamination by an FM-index per training shard.

A window is ``n`` consecutive words of a benchmark item, or all of a shorter item.  Each task cuts
its documents into shards of at most ``shard_words`` words, indexes each and searches all
windows backwards in it; located occurrences become spans, and overlapping spans merge.

Only words of some window can be part of an occurrence, so every other word is one separator
symbol in the index, and stretches between separators that are too short for the shortest window
are left out: the occurrences are the same.  Documents never move between tasks.  Windows are sent to the
tasks in blocks of at most ``block_bytes`` of benchmark text, one pass for each block, so what is
broadcast is bounded for a benchmark of any size.

Defined cases: a null or word-less text has 0 words and is not contaminated; a null or word-less item has no
window and a null item_id is left out; items of one item_id count once; repeated rows get equal
results; empty tables give no rows, an empty benchmark no hits; all columns of ``docs``, whatever their
names, travel in the struct ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnlens.llm.common import alnum_words, lean, sliced
from attnlens.llm.fmindex import FMIndex

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20
#: A document is contaminated if it has a hit and SHARE * n_hit >= n_words.
SHARE = 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN),
                      T.StructField("items", T.ArrayType(T.StringType()))])


class Windows:
    """The distinct windows of a block of items, with the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        seen: dict[tuple[int, ...], set[int]] = {}
        number: dict[str, int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            if not ids:
                continue
            if item not in number:
                number[item] = len(self.items)
                self.items.append(item)
            for k in range(max(1, len(ids) - n + 1)):
                seen.setdefault(tuple(ids[k : k + n]), set()).add(number[item])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in seen:
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(np.array(ws, np.int64), [sorted(seen[w]) for w in ws]) for _, ws in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)
        self.longest = max(by_length, default=0)

    def ids(self, text: str | None) -> np.ndarray:
        words = alnum_words(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, list[int]]]]:
        """Starts and ends of all occurrences in ``ids``, and for each found window its starts and items."""
        kept = _stretches(ids, self.shortest)
        none = np.zeros(0, np.int64)
        if not len(kept):
            return none, none, []
        index = FMIndex(ids[kept])
        starts, ends, by_items = [], [], []
        for patterns, owners in self.groups:
            low, high = index.count(patterns)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            sizes = (high - low)[hit]
            rows = np.repeat(low[hit] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            at = kept[index.locate(rows)]
            starts.append(at)
            ends.append(at + patterns.shape[1])
            for k, part in zip(hit, np.split(at, np.cumsum(sizes)[:-1]), strict=True):
                by_items.append((part, owners[k]))
        return (np.concatenate(starts), np.concatenate(ends), by_items) if starts else (none, none, [])


def _stretches(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Places of ``ids`` in runs of known words of at least ``shortest``, and one separator after each run."""
    known = np.r_[False, ids > 0, False]
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    long_ = end - begin >= shortest
    begin, end = begin[long_], np.minimum(end[long_] + 1, len(ids))
    sizes = end - begin
    return np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else begin


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted, disjoint ones."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    fresh = np.r_[True, starts[1:] > reach[:-1]]
    return starts[fresh], reach[np.r_[fresh[1:], True]]


def _search(texts: Iterable[str | None], windows: Windows, shard_words: int) -> list[tuple[int, list, list[str]]]:
    """(words, merged spans, items) of each text, indexing the texts in shards."""
    out: list[tuple[int, list, list[str]]] = []
    group: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        # a separator after each text; the last of a run's places may be that separator
        lengths = np.array([len(x) for x in group], np.int64)
        begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        whole = np.zeros(int((lengths + 1).sum()), np.int32)
        for b, x in zip(begin, group, strict=True):
            whole[b : b + len(x)] = x
        found_s, found_e, items = [], [], [set() for _ in group]
        step = max(shard_words, 4 * windows.longest)
        for at in range(0, len(whole), step):  # one very long text takes several shards, which overlap
            s, e, by_items = windows.occurrences(whole[at : at + step + windows.longest - 1])
            found_s.append(s + at)
            found_e.append(e + at)
            for places, owners in by_items:
                for d in np.unique(np.searchsorted(begin, places + at, side="right") - 1):
                    items[d].update(owners)
        s, e = merge_spans(np.concatenate(found_s), np.concatenate(found_e))
        doc = np.searchsorted(begin, s, side="right") - 1
        first = np.searchsorted(doc, np.arange(len(group) + 1))
        for d in range(len(group)):
            spans = [{"start": int(s[i] - begin[d]), "end": int(e[i] - begin[d])} for i in range(first[d], first[d + 1])]
            out.append((int(lengths[d]), spans, [windows.items[i] for i in sorted(items[d])]))
        group, size = [], 0

    for text in texts:
        ids = windows.ids(text)
        group.append(ids)
        size += len(ids) + 1
        if size >= shard_words:
            flush()
    if group:
        flush()
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size; one block is on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // block_bytes) + 1
    for part in range(parts):
        of = items if parts == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        yield [(r["item"], r["text"]) for r in of.toLocalIterator()]


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all of ``docs``) and ``found``: ``n_words``, the merged ``spans`` of hit words and the ``items``."""
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(FOUND).alias("found"))
    schema = T.StructType([out.schema["row"], T.StructField("found", FOUND)])
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast((block, n))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = Windows(*sent.value)
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                              ("items", pa.list_(pa.string()))])
            for batch in batches:
                row = batch.column(0)
                texts = sliced(pa.compute.struct_field(row, text))
                found = [{"n_words": w, "spans": s, "items": i} for w, s, i in _search(texts, windows, shard_words)]
                if batch.column(1).null_count < len(batch):  # the passes before this one
                    found = [_joined(a, b) for a, b in zip(batch.column(1).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([row, pa.array(found, kind)], ["row", "found"])

        out = out.mapInArrow(lean(search), schema)
    return out


def _joined(a: dict, b: dict) -> dict:
    spans = a["spans"] + b["spans"]
    s, e = merge_spans(*(np.array([x[k] for x in spans], np.int64) for k in ("start", "end")))
    return {"n_words": b["n_words"], "spans": [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)],
            "items": sorted({*a["items"], *b["items"]})}


def with_verdict(found: DataFrame) -> DataFrame:
    """``found`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return (found.withColumn("n_words", F.col("found.n_words")).withColumn("n_hit", hit)
            .withColumn("n_items", F.size("found.items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(F.sort_array("found.items"), ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))))


def cleaned(text: str, spans: list[dict]) -> str:
    """``text`` without the words in ``spans``; what stands between words stays."""
    import re

    from attnlens.llm.common import ALNUM_WORD_RE

    out, last = [], 0
    gone = {i for s in spans for i in range(s["start"], s["end"])}
    for i, m in enumerate(re.finditer(ALNUM_WORD_RE, text)):
        if i in gone:
            out.append(text[last : m.start()])
            last = m.end()
    return "".join([*out, text[last:]])
