"""Matrix kernels against closed forms and dense algebra; streams and limits against their batch forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnlens.operators import analysis, capture, edges, samples, signals, snapshots, spectra
from attnlens.sources.tokens import KEY, tokens
from attnlens.streaming import windows

SF = "/root/testdata/sf0.001"


def _edges(spark, m, column="p"):
    rows = [(0, 0, 0, i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, f"request_id bigint, layer_idx int, head int, i int, j int, {column} double")


def _dense(df, column):
    n = df.agg(F.max("i")).first()[0] + 1
    m = np.zeros((n, n))
    for r in df.select("i", "j", column).collect():
        m[r["i"], r["j"]] = r[column]
    return m


def test_frustration_vanishes_for_symmetric_scores(spark):
    a = np.random.default_rng(0).normal(size=(12, 12))
    assert spectra.frustration(_edges(spark, a + a.T, "s")).first()["frustration"] < 1e-9
    assert spectra.frustration(_edges(spark, a, "s")).first()["frustration"] > 1e-3


def test_frustration_witness_is_a_unit_vector(spark):
    a = np.random.default_rng(1).normal(size=(9, 9))
    w = [r["witness"] for r in spectra.frustration_witness(_edges(spark, a, "s")).collect()]
    assert len(w) == 9 and abs(sum(x * x for x in w) - 1) < 1e-9


def test_matrix_features_equal_dense_values(spark):
    m = np.abs(np.random.default_rng(2).normal(size=(10, 10)))
    got = spectra.matrix_features(_edges(spark, m), rank=3).first()
    assert np.allclose(got["sigmas"], np.linalg.svd(m, compute_uv=False)[:3])
    assert np.isclose(got["sigma2_asym"], np.linalg.svd((m - m.T) / 2, compute_uv=False)[1])


def test_conductance_of_two_blocks_is_small(spark):
    phi = lambda m: spectra.conductance(_edges(spark, m)).first()["phi_hat"]
    blocks = np.kron(np.eye(2), np.ones((5, 5))) + 0.01
    assert phi(blocks) < 0.05 < phi(np.random.default_rng(3).random((10, 10)))
    assert phi(np.zeros((4, 4))) == 0.0 and phi(np.ones((1, 1))) == 0.0


def test_sweep_against_every_set(spark):
    rng = np.random.default_rng(4)
    m, u, v = rng.random((6, 6)) * (rng.random((6, 6)) > 0.3), rng.normal(size=6), rng.normal(size=6)
    e = _edges(spark, m)
    key = e.select(*KEY).first()
    vectors = spark.createDataFrame([(*key, s, i, float(x)) for s, side in enumerate((u, v)) for i, x in enumerate(side)], "request_id bigint, layer_idx int, head int, side int, i int, value double")
    got = spectra.sweep(e, vectors).first()
    d = np.r_[m.sum(1), m.sum(0)]
    for way, name in ((1, "phi_up"), (-1, "phi_down")):
        order, best = np.argsort(way * np.r_[u, v]), 1e9
        for k in range(1, 12):
            s = np.zeros(12, bool)
            s[order[:k]] = True
            cut = sum(m[i, j] for i in range(6) for j in range(6) if s[i] != s[6 + j])
            best = min(best, cut / min(d[s].sum(), d[~s].sum()))
        assert abs(got[name] - best) < 1e-9
    assert abs(got["mean"] - (u @ m.sum(1) + v @ m.sum(0)) / m.sum()) < 1e-9


def test_commutator_equals_dense_product(spark):
    m = np.random.default_rng(5).random((8, 8))
    s, a = (m + m.T) / 2, (m - m.T) / 2
    want = np.linalg.norm(s @ a - a @ s) / np.linalg.norm(m)
    assert abs(spectra.commutator(_edges(spark, m)).first()["commutator_norm"] - want) < 1e-9


def test_last_prefix_is_the_whole(spark):
    p = edges.attention(tokens(spark, SF))
    whole = {tuple(r[k] for k in KEY): r for r in signals.asymmetry(p).collect()}
    last = signals.asymmetry_of_prefixes(p).where("n = 20").collect()
    assert len(last) == len(whole)
    for r in last:
        w = whole[tuple(r[k] for k in KEY)]
        assert all(abs(r[c] - w[c]) < 1e-9 for c in ("g", "gamma", "c"))


def test_spectral_summary_of_short_lists(spark):
    df = spark.createDataFrame([(0, [10.0, 5.0, 2.0]), (1, [7.0]), (2, []), (3, [0.0, 0.0]), (4, [5.0, 0.0])], "id int, sigmas array<double>")
    got = {r["id"]: (r["sv1"], r["sv_ratio"], r["sv_entropy"] is None) for r in spectra.spectral_summary(df).collect()}
    assert got == {0: (10.0, 2.0, False), 1: (7.0, None, False), 2: (None, None, True), 3: (0.0, None, True), 4: (5.0, None, False)}


def test_snapshots_scrub_and_survive_json(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0, float("nan"), float("inf"), 0.5)], "request_id bigint, layer_idx int, head int, g double, gamma double, c double")
    snaps = snapshots.snapshots({"asymmetry": df}, 3)
    snapshots.write_json(snaps, str(tmp_path / "s"))
    back = snapshots.read_json(spark, str(tmp_path / "s")).first()["features"]
    assert (back["g"], back["gamma"], back["c"], back["eigvals"]) == (None, None, 0.5, None)


@pytest.mark.parametrize("hot", [5, 100])
def test_numbers_of_hot_keys(spark, hot):
    """Numbers over ranges are those of one window, with a hot key, null keys, null and equal order values."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 11 == 0 else 0 if i % 3 else i % 5, None if i % 7 == 0 else int(rng.integers(12)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    got = {(r["k"], r["id"]): r["at"] for r in analysis.numbered(df, ["k"], ["t", "id"], hot=hot, parts=8).collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({(key, r[2]): n for n, r in enumerate(mine, 1)})
    assert got == want
    assert analysis.numbered(df.limit(0), ["k"], ["t", "id"]).count() == 0


def test_first_rows_are_cut_before_the_shuffle(spark):
    got = samples.first_of_each(spark.range(100).selectExpr("id % 2 k", "id"), "k", ["id"], 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("Exchange") :] and plan.count("WindowGroupLimit") == 2
    assert sorted(map(tuple, got.collect())) == [(k, 2 * i + k, i) for k in (0, 1) for i in range(3)]


def test_auroc_counts_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(9)), int(rng.integers(2))) for g in range(3) for _ in range(80)] + [(7, 1.0, 1)]
    got = {r["g"]: r["auroc"] for r in analysis.auroc(spark.createDataFrame(rows, "g int, x double, y int"), ["g"], "x", "y").collect()}
    for g in range(3):
        pos, neg = ([x for h, x, y in rows if h == g and y == c] for c in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(got.pop(g) - want) < 1e-12
    assert not got


def test_bootstrap_limits_hold_the_value(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, float(rng.normal(i % 2)), i % 2) for i in range(60)] + [(1, i, 1.0, 1) for i in range(12)]
    got = {r["l"]: r for r in analysis.bootstrap_auroc(spark.createDataFrame(rows, "l int, id int, x double, y int"), "l", "id", "x", "y").collect()}
    assert got[0]["low"] < got[0]["auroc"] < got[0]["high"] and got[1]["auroc"] is None


def test_stream_state_outlives_a_batch(spark, tmp_path):
    """Windows that begin in one micro-batch end in the next."""
    for k in range(3):
        spark.createDataFrame([(u, k * 10 + i, 1.0) for u in (1, 2) for i in range(5)], "user_id bigint, event_id bigint, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, event_id bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.drained(windows.tumbling(stream, "user_id", ["event_id"], 4), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == [(u, w, 4, 4.0) for u in (1, 2) for w in range(3)]


@pytest.mark.parametrize(("name", "layer"), [("model.layers.12.attn", 12), ("transformer.h.3", 3), ("lm_head", None)])
def test_layer_index(spark, name, layer):
    assert spark.range(1).select(capture.layer_index(F.lit(name)).alias("x")).first()["x"] == layer
