"""Signals of growing prefixes on the state store: tokens of a head come in batches, and each batch adds what its tokens change.

State of a (request, layer, head), in the store between batches: asymmetry keeps the keys so far, the potential of each token and two sums; the cyclic count keeps queries and keys so far and
each token's wins.  That is in proportion to the tokens, which exact prefixes need.  A token at position 0 where there are others already begins its request anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attnlens.operators.signals import EPS
from attnlens.sources.tokens import KEY

_KEY_DDL = "request_id bigint, layer_idx int, head int"
#: Tokens whose rows of weights are made together.
ROWS = 64


def _runs(rows: pd.DataFrame, began: bool) -> Iterator[pd.DataFrame]:
    """The batch's tokens, cut where a request begins anew."""
    anew = np.flatnonzero((rows["pos"] == 0).to_numpy())
    cuts = sorted({0, *(int(a) for a in anew if a or began), len(rows)})
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield rows.iloc[a:b]


def _folded(tokens: DataFrame, order: list[str], start: Callable[[], dict], fold: Callable[[dict, np.ndarray, np.ndarray], Iterator[tuple]], kinds: dict[str, str], out: str) -> DataFrame:
    """``fold(state, q, k)`` of every run of new tokens, ``ROWS`` at most at a time; ``kinds``: the state's arrays (binary) and numbers."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = start()
        if state.exists:
            now = {c: np.frombuffer(v, np.float64).copy() if kinds[c] == "binary" else v for c, v in zip(kinds, state.get, strict=True)}
        rows, found = pd.concat(list(batches)).sort_values(order, kind="stable"), []
        for part in _runs(rows, now["n"] > 0):
            if part["pos"].iloc[0] == 0 and now["n"]:
                now = start()
            for at in range(0, len(part), ROWS):
                some = part.iloc[at : at + ROWS]
                found += fold(now, np.array(some["q"].tolist(), np.float64), np.array(some["k"].tolist(), np.float64))
        state.update(tuple(v.tobytes() if kinds[c] == "binary" else v for c, v in now.items()))
        yield pd.DataFrame([(*key, *f) for f in found], columns=[*KEY, *names])

    columns = dict.fromkeys([*KEY, "pos", "q", "k", *order])
    return tokens.select(*columns).groupBy(*KEY).applyInPandasWithState(
        run, f"{_KEY_DDL}, {out}", ", ".join(f"{c} {k}" for c, k in kinds.items()), "append", GroupStateTimeout.NoTimeout)


def asymmetry(tokens: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``n, g, gamma, c`` of every prefix, as ``signals.asymmetry_of_prefixes`` gives them for the whole table."""

    def start() -> dict:
        return {"n": 0, "whole": 0.0, "diagonal": 0.0, "keys": np.empty(0), "potential": np.empty(0)}

    def fold(now: dict, q: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
        before, new, d = now["n"], len(q), q.shape[1]
        now["keys"] = np.concatenate([now["keys"], k.ravel()])
        s = q @ now["keys"].reshape(-1, d).T / d**0.5
        s[np.arange(before + new) > np.arange(before, before + new)[:, None]] = -np.inf
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = p[np.arange(new), before + np.arange(new)]
        # a token's potential is half of what it gives less what it gets; it gives 1 from its own row on
        r = np.concatenate([now["potential"], np.zeros(new)]) - np.cumsum(p, 0) / 2 + (np.arange(before + new) >= before) * 0.5
        whole, diagonal = now["whole"] + np.cumsum((p * p).sum(1)), now["diagonal"] + np.cumsum(own * own)
        for t in range(new):
            n = before + t + 1
            asym, grad, fro = (whole[t] - diagonal[t]) / 2, 2 * float(r[t, :n] @ r[t, :n]) / n, whole[t] ** 0.5
            yield n, *(max(x, 0.0) ** 0.5 / fro if fro > EPS else 0.0 for x in (asym, grad, asym - grad))
        now |= {"n": before + new, "whole": float(whole[-1]), "diagonal": float(diagonal[-1]), "potential": r[-1]}

    return _folded(tokens, order or ["pos"], start, fold, {"n": "bigint", "whole": "double", "diagonal": "double", "keys": "binary", "potential": "binary"},
                   "n bigint, g double, gamma double, c double")


def cyclic(tokens: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``n, t_cyc`` of every prefix, as ``signals.cyclic_prefixes`` gives them."""

    def start() -> dict:
        return {"n": 0, "count": 0, "queries": np.empty(0), "keys": np.empty(0), "wins": np.empty(0)}

    def fold(now: dict, q: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
        before, new, d = now["n"], len(q), q.shape[1]
        now["queries"], now["keys"] = np.concatenate([now["queries"], q.ravel()]), np.concatenate([now["keys"], k.ravel()])
        wins, count = np.concatenate([now["wins"], np.zeros(new)]), now["count"]
        qs, ks = now["queries"].reshape(-1, d), now["keys"].reshape(-1, d)
        for t in range(before, before + new):
            # one product after the other, as equal scores are ties
            lost = np.array([sum(a * b for a, b in zip(qs[j], ks[t])) >= sum(a * b for a, b in zip(qs[t], ks[j])) for j in range(t)], bool)
            won = int((~lost).sum())
            count += t * (t - 1) // 2 - won * (won - 1) // 2 - int(wins[:t][lost].sum())
            wins[:t] += lost
            wins[t] = won
            yield t + 1, count
        now |= {"n": before + new, "count": count, "wins": wins}

    return _folded(tokens, order or ["pos"], start, fold, {"n": "bigint", "count": "bigint", "queries": "binary", "keys": "binary", "wins": "binary"}, "n bigint, t_cyc bigint")


def slices(rows: DataFrame, key: str, order: list[str], span: str, most: int) -> DataFrame:
    """``operators.slices.sliding`` over a stream: ``key, at, n_slices, n_tokens`` after each slice; the state is the spans held."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for size in pd.concat(list(batches)).sort_values(order, kind="stable")[span].tolist():
            at += 1
            held.append(size)
            total, drop = sum(held), 0
            while most > 0 and total > most:
                total, drop = total - held[drop], drop + 1
            del held[:drop]
            out.append((k[0], at, len(held), total))
        state.update((at, held))
        yield pd.DataFrame(out, columns=[key, "at", "n_slices", "n_tokens"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, span, *order).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, at bigint, n_slices bigint, n_tokens bigint", "at bigint, held array<bigint>", "append", GroupStateTimeout.NoTimeout)
