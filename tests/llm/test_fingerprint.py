"""Fingerprints against a plain computation of the same sketch."""

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from attnlens.llm import fingerprint

LIMIT = -(1 << 63) + (1 << 64) // fingerprint.SCALE


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _sketch(text):
    h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    out = set()
    for k in range(max(1, len(h) - fingerprint.WIDTH + 1) if h else 0):
        seed = 42
        for v in h[k : k + fingerprint.WIDTH]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        out.add(_signed(seed))
    return {v for v in out if v < LIMIT} or ({min(out)} if out else set())


def _text(s):
    return f"{len(s)}:" + "".join(format(v & (1 << 64) - 1, "x") for v in sorted(s))


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        a, b, c = _sketch(t), _sketch(edited), _sketch(other)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _text(a), _text(b), _like(a, b), _like(a, c), *(len(a & x) / len(a) if a else 1.0 for x in (b, c))


def test_all_documents_equal_the_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = list(_expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect())) == want


def test_nulls_empty_and_long_texts_ties_and_clashing_names(spark):
    rows = [(3, "a b c d e f g h", "x", 1), (1, None, "y", None), (2, "", None, 3), (7, "x " * 60_000 + "y z", "z", 4), (9, "one", "q", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string, sk int")
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect())) == list(_expected([r[:2] for r in rows]))
    twice = fingerprint.fingerprints(docs.unionByName(docs)).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2} and len(twice) == 5
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_null_outlying_and_repeated_ids_do_not_fill_a_block(spark):
    rows = [(k, f"text number {k}") for k in range(4000)] + [(1 << 60, "far"), (None, "no id")] + [(5000, f"the same id {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ident, tie = F.coalesce("doc_id", F.lit(fingerprint.NULL_ID)), F.xxhash64("text")
    sizes = [r["count"] for r in docs.groupBy(fingerprint._blocks(docs, ident, tie, 12)).count().collect()]
    assert len(sizes) >= 11 and max(sizes) < 900
    got = fingerprint.with_next(docs, "doc_id", ["doc_id", "text"], rows_per_block=500).collect()
    after = {r["text"]: r["_next"]["text"] for r in got}
    assert len(got) == len(rows) == len(after) == len(set(after.values()))
    assert all(after[f"text number {k}"] == f"text number {k + 1}" for k in range(3999))
    assert after["no id"] == "text number 0" and after["far"] == "no id" and after["text number 3999"].startswith("the same id")


def test_sketch_of_a_union_and_containment(spark):
    """What a short text holds of itself in a long one is told by the sketches alone."""
    words = [f"w{k * k % 977}x{k}" for k in range(3000)]
    short, long_ = " ".join(words[:400]), " ".join(words)
    r = spark.createDataFrame([(short, long_, " ".join(words[:1000]), " ".join(words[996:]))], "s string, l string, a string, b string").select(
        fingerprint.containment(fingerprint.sketch(F.col("s")), fingerprint.sketch(F.col("l"))).alias("of_short"),
        fingerprint.containment(fingerprint.sketch(F.col("l")), fingerprint.sketch(F.col("s"))).alias("of_long"),
        (F.array_sort(F.array_union(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))) == fingerprint.sketch(F.col("l"))).alias("union")).first()
    assert r["of_short"] == 1 and abs(r["of_long"] - 396 / 2996) < 0.03 and r["union"]
