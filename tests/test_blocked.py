"""Block products, Krylov rounds, probes and sweeps against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnlens.operators import blocked, krylov
from attnlens.sources.tokens import KEY


def toks(spark, lengths, seed=0, d=8, scale=1.0):
    rng, rows = np.random.default_rng(seed), []
    for r, n in enumerate(lengths):
        q, k = rng.normal(size=(n, d)) * scale, rng.normal(size=(n, d)) * scale
        rows += [(r, 0, 1, i, q[i].tolist(), k[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "request_id bigint, layer_idx int, head int, pos int, q array<double>, k array<double>")


def dense(tok, request, causal=True, normalized=True):
    rows = sorted(tok.where(F.col("request_id") == request).collect(), key=lambda r: r["pos"])
    q, k = (np.array([r[c] for r in rows]) for c in ("q", "k"))
    s = q @ k.T / q.shape[1] ** 0.5
    p = np.exp(s - s.max(1, keepdims=True)) * (np.tril(np.ones_like(s)) if causal else 1)
    p /= p.sum(1, keepdims=True)
    return (p / np.sqrt(p.sum(0)) if normalized else p), s


def vectors(df, column="x"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["request_id"], r["block"])):
        out.setdefault(r["request_id"], []).append(np.frombuffer(r[column], np.float64).reshape(r["n"], -1))
    return {k: np.vstack(v) for k, v in out.items()}


@pytest.mark.parametrize(("causal", "normalized", "size"), [(True, True, 7), (False, False, 100)])
def test_products_and_squares_equal_dense_ones(spark, causal, normalized, size):
    tok = toks(spark, [1, 2, 20, 33])
    rows = blocked.attention(tok, causal, normalized, size)
    probes = blocked.sign_probes(rows, 3, 5)
    got = vectors(blocked.product(rows, probes, causal), "out")
    sums = {r["request_id"]: r for r in blocked.squares(rows, causal).collect()}
    for r, n in enumerate((1, 2, 20, 33)):
        m, z = dense(tok, r, causal, normalized)[0], blocked.signs(5, 3, np.arange(n))
        assert np.allclose(got[r], np.hstack([m @ z, m.T @ z]), atol=1e-12)
        a = (m - m.T) / 2
        assert np.allclose([sums[r][c] for c in ("fro2", "sym", "r2", "n")], [(m * m).sum(), (m * m.T).sum(), (a.sum(1) ** 2).sum(), n])


def test_lanczos_pairs_equal_numpy(spark, size=3):
    tok = toks(spark, [1, 2, 6])
    rows = blocked.attention(tok, size=size)
    found = krylov.svd_by_lanczos(rows, 4).cache()
    sigmas = {r["request_id"]: r["sigmas"] for r in krylov.window_sigmas(found).collect()}
    u, v = vectors(found, "u"), vectors(found, "v")
    for r in range(3):
        m = dense(tok, r)[0]
        want = np.linalg.svd(m, compute_uv=False)[:4]
        assert np.allclose(sigmas[r], want, atol=1e-8), (r, sigmas[r], want)
        assert np.allclose(m @ v[r], u[r] * sigmas[r], atol=1e-7) and np.allclose(u[r].T @ u[r], np.eye(len(want)), atol=1e-8)
    assert krylov.svd_by_lanczos(rows, 0).count() == 0


def test_a_long_window_needs_no_matrix(spark):
    """1,000 tokens in four blocks; no task sees more than one block's weights."""
    tok = toks(spark, [1000], seed=3, scale=0.6)
    rows = blocked.attention(tok)
    assert rows.count() == 4
    got = krylov.window_sigmas(krylov.svd_by_lanczos(rows, 2, iters=8)).first()["sigmas"]
    assert np.allclose(got[:1], np.linalg.svd(dense(tok, 0)[0], compute_uv=False)[:1], atol=1e-5)


def test_a_vanishing_vector_ends_the_rounds(spark):
    """Equal keys give uniform attention without a mask: rank 1."""
    tok = toks(spark, [6]).withColumn("k", F.array(*[F.lit(1.0)] * 8))
    rows = blocked.attention(tok, causal=False, normalized=False, size=4)
    got = krylov.window_sigmas(krylov.svd_by_lanczos(rows, 3, kernel=blocked.both_ways(False))).first()["sigmas"]
    assert abs(got[0] - 1) < 1e-9 and all(s < 1e-7 for s in got[1:]) and len(got) <= 3


def test_random_probes_are_near_the_exact_values(spark, size=6):
    tok = toks(spark, [1, 2, 7, 40], seed=2)
    rows = blocked.attention(tok, size=size)
    found = krylov.randomized_svd(rows, 4).cache()
    sigmas = {r["request_id"]: r["sigmas"] for r in krylov.window_sigmas(found).collect()}
    u, v = vectors(found, "u"), vectors(found, "v")
    for r in range(4):
        m = dense(tok, r)[0]
        want = np.linalg.svd(m, compute_uv=False)[:4]
        assert np.allclose(sigmas[r], want, rtol=2e-2) and np.allclose(sigmas[r][:2], want[:2], rtol=1e-3)
        assert np.allclose(u[r].T @ u[r], np.eye(len(want)), atol=1e-9) and np.allclose(v[r].T @ v[r], np.eye(len(want)), atol=1e-7)
    again = krylov.window_sigmas(krylov.randomized_svd(blocked.attention(tok.where("request_id = 3").repartition(5), size=40), 4)).first()["sigmas"]
    assert np.allclose(again, sigmas[3], atol=1e-9)  # neither partitions nor blocks change the probes
    assert krylov.randomized_svd(rows, 0).count() == krylov.randomized_svd(rows, -2).count() == 0


def test_magnetic_laplacian(spark, size=4):
    tok = toks(spark, [2, 7], seed=6)
    got = {r["request_id"]: r["frustration"] for r in krylov.frustration(tok, size=size).collect()}
    witness = {}
    for r in krylov.frustration_witness(tok, size=size).collect():
        witness.setdefault(r["request_id"], {})[r["i"]] = r["witness"]
    for r, n in enumerate((2, 7)):
        s = dense(tok, r)[1]
        w, both = (abs(s) + abs(s.T)) / 2, s + s.T
        np.fill_diagonal(w, 0)
        lap = np.diag(w.sum(1)) - w * np.exp(1j * np.arctan((s - s.T) / both))
        values, vecs = np.linalg.eigh(lap)
        assert abs(got[r] - max(0, values[0])) < 1e-8
        assert np.allclose([witness[r][i] for i in range(n)], abs(vecs[:, 0]), atol=1e-5)
    assert krylov.hermitian_lanczos(blocked.blocks(tok, size), 0).count() == 0


def test_sign_probes_are_unbiased(spark):
    """Means over seeds come near the exact squared norms; many probes come nearer."""
    tok = toks(spark, [16], seed=7, scale=2.0)
    rows = blocked.attention(tok, size=6)
    m = dense(tok, 0)[0]
    a, s = (m - m.T) / 2, (m + m.T) / 2
    want_a, want_c = (a * a).sum(), ((s @ a - a @ s) ** 2).sum()
    found_a = [blocked.asymmetry_estimate(rows, 20, seed).first()["s_asym"] for seed in range(2)]
    found_c = [blocked.commutator_estimate(rows, 20, seed).first()["c2"] for seed in range(2)]
    assert abs(np.mean(found_a) / want_a - 1) < 0.3 and abs(np.mean(found_c) / want_c - 1) < 0.5
    z = blocked.signs(0, 20, np.arange(16))
    assert abs(found_a[0] - ((a @ z) ** 2).sum() / 20) < 1e-10 and abs(found_c[0] - (((s @ a - a @ s) @ z) ** 2).sum() / 20) < 1e-10
    by_token = vectors(blocked.asymmetry_probes(rows, 20, 0), "out")[0][:, 0]
    assert np.allclose(by_token, ((a @ z) ** 2).mean(1)) and abs(by_token.sum() - found_a[0]) < 1e-10


@pytest.mark.parametrize(("causal", "turn"), [(True, -1.0), (False, 0.01)])
def test_sweep_without_edges_against_every_set(spark, causal, turn):
    tok = toks(spark, [6], seed=8)
    rows = blocked.attention(tok, causal, size=4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 2)) * 0.05 + turn * 0.2
    m = dense(tok, 0, causal)[0]
    table = spark.createDataFrame([(0, 0, 1, b, x[4 * b : 4 * b + 4].tobytes()) for b in (0, 1)], "request_id bigint, layer_idx int, head int, block int, x binary")
    got = blocked.conductance(rows, table, causal).first()["phi_hat"]
    d, best = np.r_[m.sum(1), m.sum(0)], []
    values = (x if x.mean(0).sum() >= 0 else -x).T.ravel()
    for way in (1, -1):
        order, low = np.argsort(way * values, kind="stable"), 1e9
        for k in range(1, 12):
            inside = np.zeros(12, bool)
            inside[order[:k]] = True
            cut = sum(m[i, j] for i in range(6) for j in range(6) if inside[i] != inside[6 + j])
            low = min(low, cut / min(d[inside].sum(), d[~inside].sum()))
        best.append(low)
    clear = abs(x.mean(0).sum()) > 0.1
    assert abs(got - max(0, min(best[0] if clear else min(best), 1))) < 1e-9


def test_features(spark, method="randomized"):
    tok = toks(spark, [1, 2, 8], seed=10)
    got = {r["request_id"]: r for r in krylov.matrix_free(tok, method=method, size=5).collect()}
    m = dense(tok, 2)[0]
    a = (m - m.T) / 2
    s = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(got[2]["sigma2"], s[1], rtol=1e-3) and np.allclose(got[2]["sigma2_asym"], np.linalg.svd(a, compute_uv=False)[1], rtol=1e-3)
    fro, r = np.linalg.norm(m), a.sum(1)
    assert np.allclose([got[2]["g"], got[2]["gamma"]], [np.linalg.norm(a) / fro, np.sqrt(2 * (r @ r) / 8) / fro])
    assert 0 <= got[2]["phi_hat"] <= 1 and len(got[2]["sigmas"]) == 4 and got[0]["sigmas"] == [] and got[0]["phi_hat"] == 0
    assert set(got[0].asDict()) == {*KEY, "sigmas", "sigma2", "sigma2_asym", "commutator_norm", "phi_hat", "g", "gamma", "c"}


@pytest.mark.parametrize("name", ["svd_by_lanczos", "randomized_svd", "hermitian_lanczos"])
def test_short_windows_in_one_task_equal_spread_ones(spark, monkeypatch, name):
    """The same rounds, spread over tasks or not, and a table that has both; a short window is one row of its task, not one of every round."""
    tok = toks(spark, [1, 2, 6, 16])
    rows = blocked.attention(tok, size=3)
    value = "values" if name.startswith("h") else "sigmas"
    found = []
    for most in (0, 12, 10**6):
        monkeypatch.setattr(krylov, "SHORT", most)
        df = getattr(krylov, name)(rows, 2)
        found.append({(r["request_id"], r["block"]): (r["n"], np.round(r[value], 7).tolist()) for r in df.collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == rows.count()
    monkeypatch.setattr(krylov, "_step", None)
    assert getattr(krylov, name)(rows, 2).count() == len(found[0])
