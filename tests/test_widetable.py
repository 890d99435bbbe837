"""The wide table of all eight signals, and what it refuses."""

import pytest
from pyspark.sql import functions as F

from attnlens.operators import widetable
from attnlens.registry import COMPUTE, Plan, compute
from attnlens.sources.tokens import KEY, tokens

SF = "/root/testdata/sf0.001"
TOPS = {"selfattn": 2, "laplacian": 3}


def samples(spark, requests=3):
    return spark.createDataFrame([(r, r % 2, 100 + r, "full", "made") for r in range(requests)], "request_id bigint, label int, sample_id bigint, phase string, source string")


def test_all_signals_have_their_columns(spark, tmp_path):
    tok = tokens(spark, SF).where("request_id < 3 and head = 0")
    found = {name: compute(tok, Plan(name)) for name in COMPUTE}
    asked = widetable.columns(sorted(COMPUTE), 2, [0], TOPS)
    assert len(asked) == 2 * (3 + 11 + 6 + 1 + 3 + 1 + 1 + 5) and len(set(asked)) == len(asked)
    table = widetable.wide(widetable.long(found, TOPS), samples(spark), asked)
    assert widetable.write(table, str(tmp_path / "wide")) == {"rows": 3, "empty": 0}
    back = spark.read.parquet(str(tmp_path / "wide"))
    assert back.columns == ["request_id", "label", "sample_id", "phase", "source", *asked]
    for r in found["asymmetry"].collect():
        row = back.where(F.col("request_id") == r["request_id"]).first()
        assert row[f"asymmetry_gamma_L{r['layer_idx']}_H0"] == r["gamma"] and row["label"] == r["request_id"] % 2
    with pytest.raises(ValueError, match="no signal"):
        widetable.columns(["other"], 1, [0])


def test_what_would_be_lost_is_an_error(spark):
    rows = [(r, 0, 0, "asymmetry_g", float(r)) for r in range(3)]
    long = spark.createDataFrame(rows, "request_id bigint, layer_idx int, head int, name string, value double")
    asked = widetable.columns(["asymmetry"], 1, [0])
    assert {r["request_id"]: r["asymmetry_g_L0_H0"] for r in widetable.wide(long, samples(spark), asked).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    assert widetable.wide(long, samples(spark), asked).where("asymmetry_c_L0_H0 is not null").count() == 0
    late = long.unionByName(spark.createDataFrame([(2, 0, 0, "asymmetry_new", 1.0)], long.schema))  # not in the first row
    with pytest.raises(Exception, match="no column for asymmetry_new_L0_H0"):
        widetable.wide(late, samples(spark), asked).collect()
    with pytest.raises(Exception, match="no sample of request 2"):
        widetable.wide(long, samples(spark, 2), asked).collect()
    with pytest.raises(Exception, match="without label, id or phase: request 1"):
        widetable.wide(long, samples(spark).withColumn("phase", F.when(F.col("request_id") != 1, F.col("phase"))), asked).collect()


def test_values_that_are_not_finite_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0, float("nan"), float("inf"), 0.5)], "request_id bigint, layer_idx int, head int, g double, gamma double, c double")
    got = {r["name"]: r["value"] for r in widetable.long({"asymmetry": df}).collect()}
    assert got == {"asymmetry_g": None, "asymmetry_gamma": None, "asymmetry_c": 0.5} and KEY
