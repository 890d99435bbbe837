"""Names, modes and plans of signals; the routing signal against numpy; p-values against known ones."""

import numpy as np
import pytest

from attnlens.operators import edges, report
from attnlens.registry import ADMITS, COMPUTE, Plan, all_heads, compute, named
from attnlens.sources.tokens import KEY, tokens

SF = "/root/testdata/sf0.001"


def test_names():
    assert named(["asymmetry, cyclic", "routing,asymmetry"]) == ["asymmetry", "cyclic", "routing"]
    with pytest.raises(ValueError, match="no signal 'other'"):
        named(["other"])
    assert len(COMPUTE) == 8


@pytest.mark.parametrize("bad", [{"tumbling": True}, {"streaming": True}, {"streaming": True, "window": 8}, {"incremental": True, "window": 8}, {"interval": 0}])
def test_modes_that_do_not_fit_are_refused(bad):
    with pytest.raises(ValueError):
        Plan("asymmetry", **bad)
    assert not Plan("asymmetry", enabled=False, **bad).enabled


def test_signals_admit_only_their_modes():
    for name in COMPUTE:
        for mode, more in (("streaming", {"tumbling": True, "window": 8}), ("incremental", {})):
            if mode in ADMITS.get(name, ()):
                Plan(name, **{mode: True}, **more)
            else:
                with pytest.raises(ValueError, match=f"no {mode} form"):
                    Plan(name, **{mode: True}, **more)


def test_heads():
    assert all_heads([Plan("cyclic", heads=frozenset((2, 0))), Plan("magnetic", heads=frozenset((1,)))]) == [0, 1, 2]
    assert all_heads([Plan("cyclic"), Plan("magnetic", heads=frozenset((1,)))]) == []


def test_every_signal_has_one_row_per_head(spark):
    tok = tokens(spark, SF).where("request_id < 3")
    for name in COMPUTE:
        assert compute(tok, Plan(name)).count() == 12, name
    assert compute(tok, Plan("asymmetry", window=5, tumbling=True, streaming=True)).count() == 12
    assert compute(tok, Plan("cyclic", interval=5, incremental=True)).count() == 48
    assert compute(tok, Plan("laplacian", window=6, tumbling=True, heads=frozenset((1,)))).count() == 18


def test_routing_signal_equals_numpy(spark):
    tok = tokens(spark, SF).where("request_id = 0 and layer_idx = 1 and head = 0")
    got = compute(tok, Plan("routing")).first()
    m = np.zeros((20, 20))
    for r in edges.normalized(edges.attention(tok)).collect():
        m[r["i"], r["j"]] = r["p"]
    s, a = np.linalg.svd(m, compute_uv=False), (m - m.T) / 2
    fro = np.linalg.norm(m)
    r = a.sum(1)
    g, gamma = np.linalg.norm(a) / fro, np.sqrt(2 * (r @ r) / 20) / fro
    c = np.sqrt(max(g * g - gamma * gamma, 0))
    sym = (m + m.T) / 2
    want = {"sv1": s[0], "sv_ratio": s[0] / s[1], "sigma2": s[1], "sigma2_asym": np.linalg.svd(a, compute_uv=False)[1], "g": g, "gamma": gamma, "c": c,
            "curl_ratio": c / g, "commutator_norm": np.linalg.norm(sym @ a - a @ sym) / fro}
    assert {k: round(got[k], 6) for k in want} == {k: round(float(v), 6) for k, v in want.items()}
    assert np.allclose(got["sigmas"], s[:4]) and 0 <= got["phi_hat"] <= 1 and len(got.asDict()) == len(KEY) + 12


def test_p_values():
    """Of t = r sqrt((n - 2) / (1 - r^2)): 2.228 at 10 degrees of freedom and 12.706 at one have a p of 0.05."""
    for t, df, p in ((2.228139, 10, 0.05), (12.706205, 1, 0.05), (2.085963, 20, 0.05), (1.0, 1, 0.5), (3.169273, 10, 0.01)):
        r = t / np.sqrt(df + t * t)
        assert abs(report.two_sided_p(r, df + 2) - p) < 1e-6
    assert report.two_sided_p(0.0, 12) == 1 and report.two_sided_p(1.0, 12) == 0 and report.two_sided_p(None, 12) is None and report.two_sided_p(0.5, 2) is None
