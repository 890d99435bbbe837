"""Tokens are dealt by the number of their pairs, so that a task's share does not grow with the table."""

from pyspark.sql import functions as F

from attnlens.operators import edges, signals
from attnlens.sources.tokens import KEY, tokens

SF = "/root/testdata/sf0.001"


def largest(pairs):
    """Rows, and the rows of the largest task."""
    n = [r["count"] for r in pairs.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    return sum(n), max(n)


def test_scores_of_more_tokens_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(edges, "PAIRS", 800, raising=False)
    tok = tokens(spark, SF)
    keys = tok.select(*KEY).distinct().count()
    rows, most = largest(edges.scores(tok, causal=True))
    assert rows == keys * 210 and most <= rows / 4
    assert largest(edges.scores(tok.where("pos < 0"), causal=True).unionByName(edges.scores(tok.where("pos < 1"), causal=True)))[0] == keys


def test_both_scores_of_more_tokens_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(edges, "PAIRS", 800, raising=False)
    tok = tokens(spark, SF)
    rows, most = largest(signals.both_scores(tok))
    assert rows == tok.select(*KEY).distinct().count() * 190 and most <= rows / 4
