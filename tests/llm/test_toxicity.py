"""Toxicity: the model is fitted apart and applied in plain Python; held-out quality; what a score may depend on."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attnlens.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def plain_score(model, text):
    text = text or ""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = {w for w in words} | {w[:k] + "*" for w in words for k in (3, 4, 5, 6) if len(w) > k}
    hits = [0] * toxicity.VOTERS
    for f in found:
        voter = model.lexicon.get(f.encode())
        if voter is not None:
            hits[voter] += 1
    strong, weak = sum(hits[: toxicity.STRONG]), sum(hits[toxicity.STRONG :])
    n = max(1, len(text))
    x = [math.log1p(h) for h in hits] + [math.log1p(strong), strong > 0, math.log1p(weak), weak > 0, text.count("!") / n, sum("A" <= c <= "Z" for c in text) / n,
                                         1 - len(set(words)) / max(1, len(words)), math.log1p(len(words)) / 10]
    z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True)) + model.bias
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_every_score_equals_the_model_in_plain_python(spark, tables):
    docs, labels = tables
    docs = docs.unionByName(spark.createDataFrame([(None, None, "x", "y", 0), (-5, "", "x", "y", 0), (-6, "É! " * 9000, "x", "y", 0)], docs.schema))
    model = toxicity.train(docs, labels)
    rows = toxicity.scores(docs, labels).select("row.doc_id", "row.text", "score").collect()
    assert len(rows) == docs.count()
    assert max(abs(r.score - plain_score(model, r.text)) for r in rows) < 1e-9


def test_held_out_quality(spark, tables):
    got = {r.doc_id: r for r in queries.op3_weak_supervision_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    judged = [(got[r.doc_id].score, r.toxic, got[r.doc_id].predicted) for r in tables[1].collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for s, y, _ in judged if y == 0], [s for s, y, _ in judged if y == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    named = [y for _, y, p in judged if p]
    assert auc > 0.85 and sum(named) >= 0.9 * len(named) and sum(named) >= 0.6 * len(bad)


def test_held_out_labels_and_other_columns_do_not_enter(spark, tables):
    docs, labels = tables
    before = {r.doc_id: r.score for r in toxicity.scores(docs, labels).select("row.doc_id", "score").collect()}
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("z")).withColumn("source", F.col("doc_id").cast("string"))
    after = {r.doc_id: r.score for r in toxicity.scores(other, flipped).select("row.doc_id", "score").collect()}
    assert before == after


def test_null_ids_are_not_held_out_and_a_repeated_id_counts_once(spark, tables):
    docs, labels = tables
    assert spark.range(1).select(toxicity.held_out(F.lit(None).cast("long")).alias("h")).first().h is False
    one = labels.where("toxic = 0").where(~toxicity.held_out(F.col("doc_id"))).limit(1)
    many = docs.join(one.select("doc_id"), "doc_id").crossJoin(spark.range(50).select()).select(docs.columns)
    before, after = toxicity.train(docs, labels), toxicity.train(docs.unionByName(many), labels.unionByName(one))
    assert before.lexicon == after.lexicon and (before.weights == after.weights).all()
