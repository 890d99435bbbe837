"""Signals that need a window's whole matrix: singular values, sweep cuts, Hermitian eigenpairs, commutators.

A group is one window of one head, so its size is the window's, not the data's; Spark deals the groups out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnlens.sources.tokens import KEY

EPS = 1e-10
_KEY_DDL = "request_id bigint, layer_idx int, head int"


def _matrix(part: pa.Table, *columns: str) -> list[np.ndarray]:
    i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
    n = int(max(i.max(), j.max())) + 1
    out = []
    for c in columns:
        m = np.zeros((n, n))
        m[i, j] = part.column(c).to_numpy()
        if not np.isfinite(m).all():
            raise FloatingPointError("an entry is not finite")
        out.append(m)
    return out


def _keys(part: pa.Table, rows: int = 1) -> dict[str, list]:
    return {k: [part.column(k)[0].as_py()] * rows for k in KEY}


def _per_window(edges: DataFrame, kernel: Callable[[pa.Table], dict[str, list]], ddl: str) -> DataFrame:
    """``kernel`` of each window.  A window that it fails on (entries that are not finite, no convergence) gives one row of nulls and leaves the others alone."""
    types = {"request_id": pa.int64(), "layer_idx": pa.int32(), "head": pa.int32(), "i": pa.int32(), "side": pa.int32(), "sigmas": pa.list_(pa.float64())}

    names = [x.split()[0] for x in ddl.split(", ")]

    def run(part: pa.Table) -> pa.Table:
        try:
            out = kernel(part)
        except (np.linalg.LinAlgError, FloatingPointError, ValueError):
            out = {c: [None] for c in names}
        n = len(next(iter(out.values())))
        columns = _keys(part, n) | out
        return pa.table({c: pa.array(v, types.get(c, pa.float64())) for c, v in columns.items()})

    return edges.groupBy(*KEY).applyInArrow(run, f"{_KEY_DDL}, {ddl}")


def second_pair(edges: DataFrame) -> DataFrame:
    """``side`` (0: rows, 1: columns), ``i`` and ``value`` of the second left and right singular vectors of each window with two tokens or more."""

    def kernel(part: pa.Table) -> dict[str, list]:
        left, _, right = np.linalg.svd(np.maximum(_matrix(part, "p")[0], 0))
        n = len(left) if len(left) > 1 else 0
        return {"side": [0] * n + [1] * n, "i": [*range(n)] * 2, "value": [*left[:n, 1].tolist(), *right[1].tolist()] if n else []}

    return _per_window(edges, kernel, "side int, i int, value double")


def sweep(edges: DataFrame, vectors: DataFrame, eps: float = 1e-12) -> DataFrame:
    """``phi_up, phi_down, mean`` of each window.  The nodes of both sides stand in the order of ``value``; each of its beginnings is a set whose
    cut, the weight of the edges that leave it, is compared with the smaller of its volume and the rest's.  ``phi_up`` is the least ratio, ``phi_down`` that
    of the other direction, ``mean`` the sides' means of ``value`` weighted by degree, added up."""
    e = edges.where("p > 0").select(*KEY, "i", "j", "p")
    degree = e.select(*KEY, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("i")), F.struct(F.lit(1).alias("side"), F.col("j").alias("i")))).alias("n"), "p")
    degree = degree.groupBy(*KEY, "n.side", "n.i").agg(F.sum("p").alias("degree"))
    nodes = vectors.join(degree, [*KEY, "side", "i"], "left").withColumn("degree", F.greatest(F.coalesce("degree", F.lit(0.0)), F.lit(eps)))
    sides = nodes.groupBy(*KEY, "side").agg((F.sum(F.col("value") * F.col("degree")) / (F.sum("degree") + eps)).alias("mean"))
    means = sides.groupBy(*KEY).agg(F.sum("mean").alias("mean"))
    turned = nodes.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1))))
    key = [*KEY, "way"]
    order = Window.partitionBy(*key).orderBy(F.col("value") * F.col("way"), "side", "i")
    placed = turned.withColumn("place", F.row_number().over(order))
    ends = [placed.where(F.col("side") == s).select(*key, F.col("i").alias("i" if s == 0 else "j"), F.col("place").alias(f"at{s}")) for s in (0, 1)]
    across = e.join(ends[0], [*KEY, "i"]).join(ends[1], [*key, "j"])
    # an edge is cut from its first end's place up to its last one's
    steps = across.select(*key, F.explode(F.array(F.struct(F.least("at0", "at1").alias("place"), F.col("p").alias("d")), F.struct(F.greatest("at0", "at1").alias("place"), (-F.col("p")).alias("d")))).alias("s"))
    steps = steps.groupBy(*key, "s.place").agg(F.sum("s.d").alias("d"))
    run = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sets = placed.select(*key, "place", "degree").join(steps, [*key, "place"], "left").select(
        *key, F.sum(F.coalesce("d", F.lit(0.0))).over(run).alias("cut"), F.sum("degree").over(run).alias("volume"), F.sum("degree").over(Window.partitionBy(*key)).alias("all"))
    smaller = F.least("volume", F.col("all") - F.col("volume"))
    least = lambda way: F.coalesce(F.min(F.when((F.col("way") == way) & (smaller > eps), F.col("cut") / smaller)), F.lit(1.0))
    return sets.groupBy(*KEY).agg(least(1).alias("phi_up"), least(-1).alias("phi_down")).join(means, KEY)


def conductance(edges: DataFrame, clear: float = 0.1) -> DataFrame:
    """``phi_hat`` of each window: the sweep along the second singular pair, in the direction of a mean that is not below 0; without a clear mean the
    better of both directions.  0 for windows without a pair of tokens or a positive weight."""
    found = sweep(edges, second_pair(edges))
    along, against = F.when(F.col("mean") < 0, F.col("phi_down")).otherwise(F.col("phi_up")), F.when(F.col("mean") < 0, F.col("phi_up")).otherwise(F.col("phi_down"))
    either = F.least(F.greatest(F.least(along, against), F.lit(0.0)), F.lit(1.0))
    phi = F.when((along >= 0) & (F.abs("mean") > clear), along).otherwise(either)
    some = edges.groupBy(*KEY).agg((F.max("p") > 0).alias("some"))
    return some.join(found, KEY, "left").select(*KEY, F.when(F.col("some"), F.coalesce(phi, F.lit(0.0))).otherwise(0.0).alias("phi_hat"))


def matrix_features(edges: DataFrame, rank: int | None = 4) -> DataFrame:
    """Singular values of ``p``, the second ones of it and of its antisymmetric part, and the norm of the commutator of both parts, ``(M'M - MM') / 2``, over that of ``p``."""

    def kernel(part: pa.Table) -> dict[str, list]:
        (m,) = _matrix(part, "p")
        s, a = np.linalg.svd(m, compute_uv=False), np.linalg.svd((m - m.T) / 2, compute_uv=False)
        moved = np.linalg.norm(m.T @ m - m @ m.T) / 2 / (np.linalg.norm(m) + EPS)
        return {"commutator_norm": [float(moved)], "sigmas": [s[:rank].tolist()], "sigma2": [float(s[1]) if len(s) > 1 else 0.0], "sigma2_asym": [float(a[1]) if len(a) > 1 else 0.0]}

    return _per_window(edges, kernel, "commutator_norm double, sigmas array<double>, sigma2 double, sigma2_asym double")


def spectral_summary(df: DataFrame, sigmas: str = "sigmas") -> DataFrame:
    """First value, ratio of the first two and entropy of the values' shares; null where they are not defined."""
    s = F.col(sigmas)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    entropy = -F.aggregate(s, F.lit(0.0), lambda a, x: a + x / total * F.ln(x / total + 1e-12))
    return df.withColumns({"sv1": F.get(s, F.lit(0)), "sv_ratio": F.when((F.size(s) > 1) & (F.get(s, F.lit(1)) > 0), F.get(s, F.lit(0)) / F.get(s, F.lit(1))),
                           "sv_entropy": F.when(total > 0, entropy)})


def commutator(edges: DataFrame) -> DataFrame:
    """Norm of the commutator of the symmetric and antisymmetric parts over the norm."""
    return matrix_features(edges).select(*KEY, "commutator_norm")


def _magnetic(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    (s,) = _matrix(part, "s")
    w = (abs(s) + abs(s.T)) / 2
    np.fill_diagonal(w, 0)
    both = s + s.T
    angle = np.where(both != 0, np.arctan((s - s.T) / np.where(both != 0, both, 1)), 0)
    return np.linalg.eigh(np.diag(w.sum(1)) - w * np.exp(1j * angle))


def frustration(scores: DataFrame) -> DataFrame:
    """The smallest eigenvalue of the magnetic Laplacian of all score pairs."""
    return _per_window(scores, lambda part: {"frustration": [max(0.0, float(_magnetic(part)[0][0]))]}, "frustration double")


def frustration_witness(scores: DataFrame) -> DataFrame:
    """Magnitudes of the bottom eigenvector."""

    def kernel(part: pa.Table) -> dict[str, list]:
        found = abs(_magnetic(part)[1][:, 0])
        return {"i": list(range(len(found))), "witness": found.tolist()}

    return _per_window(scores, kernel, "i int, witness double")
