"""Ranges of hot keys: their cut points differ from one evaluation to the next, numbers and ranks do not."""

import random

import pytest
from pyspark.sql import functions as F

from attnlens.operators import analysis


@pytest.fixture
def unsteady(monkeypatch):
    """Quantiles that are others in every evaluation, as those of an approximate sketch can be."""
    def cuts(column, shares, accuracy):
        draw = F.udf(lambda n: sorted(random.SystemRandom().sample(range(1000), len(shares))) if n else [], "array<bigint>")
        return draw(F.count(column))

    monkeypatch.setattr(analysis.F, "percentile_approx", cuts)


def test_balance_and_ranks_do_not_depend_on_the_cuts(spark, unsteady):
    rows = spark.range(1200).selectExpr("id % 1000 + id div 1000 * 1000 as doc_id", "cast(id >= 900 as int) as label", "id % 1000 as x", "1 as one")
    got = sorted(r["doc_id"] for r in analysis.balanced(rows, "label", "doc_id", hot=100).collect())
    assert got == [*range(300), *range(900, 1200)]
    sums = analysis.rank_sums(rows, ["one"], "x", "label").first()
    values = sorted(r["x"] for r in rows.collect())
    mid = {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    assert sums["ranks"] == sum(mid[r["x"]] for r in rows.collect() if r["label"])
