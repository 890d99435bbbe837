"""Singular values and eigenpairs of windows that no task holds as a matrix: Krylov rounds and random probes over ``blocked`` products.

The basis is a table: a row for each block of a window with the block's rows of all basis vectors.  A round is one product (spread over block pairs) and one step that makes the new vector
orthogonal to the basis, classical Gram-Schmidt twice, with a window's vectors together: tokens x rounds numbers.  Every round ends in the shared folder, so a lost executor
costs one round.  Random starts and probes are drawn for each position from a seed: the same for every partitioning and block size.

A window of few tokens (SHORT) takes the same rounds inside one task, so that many short windows cost one exchange and not two a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.operators import blocked
from attnlens.operators.blocked import KEY_DDL, Side, packed, table_of, unpacked
from attnlens.sources.shared import cut
from attnlens.sources.tokens import KEY

#: A vector of a smaller norm ends the rounds of its window.
BREAKDOWN = 1e-8
#: Triangular factors that are merged at once.
FAN = 32
#: Windows of at most so many tokens are not spread over tasks.
SHORT = 64


def normal(seed: int, columns: int, pos: np.ndarray) -> np.ndarray:
    """Gaussian numbers of each position."""
    return np.array([_normal(seed, columns, int(p)) for p in pos]).reshape(len(pos), columns)


@lru_cache(4096)
def _normal(seed: int, columns: int, p: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, p])).standard_normal(columns)


def _vectors(part: pa.Table, column: str) -> np.ndarray:
    """A window's vectors from its rows, which are in the order of the blocks."""
    return np.vstack([unpacked(raw.as_py(), n.as_py()) for raw, n in zip(part.column(column), part.column("n"), strict=True)])


def _blocks(part: pa.Table, x: np.ndarray) -> list[bytes]:
    ends = np.cumsum(part.column("n").to_numpy()).tolist()
    return [packed(x[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T.conj() @ x)
    return x


Product = Callable[[np.ndarray], np.ndarray]


def _by_size(rows: DataFrame, kernel: blocked.Kernel, short: Callable[[Product, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], long: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """``block, n`` and ``names``, a list of numbers and vectors, of each window: ``short(product, pos)`` inside a task where its tokens are few, ``long`` of the rows of the others."""
    inputs = [c for c in ("pos", "q", "k", "lse", "d") if c in rows.columns]
    size = rows.groupBy(*KEY).agg((F.sum("n") <= SHORT).alias("_short"))
    least, most = size.agg(F.min(F.col("_short").cast("int")), F.max(F.col("_short").cast("int"))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], {"block": [], "n": []} | {c: [] for c in names}
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                parts = row["parts"]
                n = [x["n"] for x in parts]
                raw = {c: b"".join(x[c] for x in parts) for c in inputs}
                pos = np.frombuffer(raw["pos"], np.int64)
                whole = Side(pos, unpacked(raw["q"], len(pos)), unpacked(raw["k"], len(pos)), *(np.frombuffer(raw[c], np.float64) if c in raw else None for c in ("lse", "d")), None)

                def product(x: np.ndarray, whole: Side = whole) -> np.ndarray:
                    side = replace(whole, x=x)
                    return sum(part for _, part in kernel(side, side, True))

                values, vectors = short(product, pos)
                ends = np.cumsum(n).tolist()
                keys += [tuple(row[k] for k in KEY)] * len(parts)
                out["block"] += [x["block"] for x in parts]
                out["n"] += n
                out[names[0]] += [values.tolist()] * len(parts)
                for c, x in zip(names[1:], vectors, strict=True):
                    out[c] += [packed(x[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            kinds = {"block": pa.int32(), "n": pa.int32(), names[0]: pa.list_(pa.float64())} | {c: pa.binary() for c in names[1:]}
            yield from table_of(keys, {c: (kinds[c], v) for c, v in out.items()}).to_batches()

    found = []
    if most != 0:
        few = rows.join(size.where("_short"), KEY, "left_semi") if least == 0 else rows
        one = few.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "n", *inputs))).alias("parts"))
        found.append(one.mapInArrow(run, f"{KEY_DDL}, block int, n int, {names[0]} array<double>, {', '.join(f'{c} binary' for c in names[1:])}"))
    if least == 0:
        found.append(long(rows.join(size.where("not _short"), KEY, "left_semi") if most else rows))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _step(state: DataFrame, kernel: blocked.Kernel, step: Callable[[dict], dict]) -> DataFrame:
    """One round: the product of each window's vector ``x``, then ``step`` with the window's basis, numbers and the product ``out``.

    The state's rows carry their tokens, and the contributions of the pairs meet them in one exchange by window."""
    names = [c for c in state.columns if c not in KEY]
    found = blocked.contributions(state.where("not ended"), kernel)

    def run(part: pa.Table) -> pa.Table:
        at = pa.compute.is_null(part.column("ended"))
        got, part = part.filter(at), part.filter(pa.compute.invert(at)).sort_by("block").drop_columns(["out"])
        now = {"p": _vectors(part, "p"), "q_": _vectors(part, "q_"), "alphas": part.column("alphas")[0].as_py(), "betas": part.column("betas")[0].as_py()}
        if part.column("ended")[0].as_py():
            return part
        ends = np.cumsum(part.column("n").to_numpy())
        begin = dict(zip(part.column("block").to_pylist(), (ends - part.column("n").to_numpy()).tolist(), strict=True))
        out = None
        for block, n, raw in zip(got.column("block").to_pylist(), got.column("n").to_pylist(), got.column("out").to_pylist(), strict=True):
            x = unpacked(raw, n)
            out = np.zeros((int(ends[-1]), x.shape[1])) if out is None else out
            out[begin[block] : begin[block] + n] += x
        now |= {"ended": False} | step(now | {"out": out})
        m = len(part)
        new = {"p": (_blocks(part, now["p"]), pa.binary()), "q_": (_blocks(part, now["q_"]), pa.binary()), "x": (_blocks(part, now["x"]) if "x" in now else part.column("x").to_pylist(), pa.binary()),
               "alphas": ([now["alphas"]] * m, pa.list_(pa.float64())), "betas": ([now["betas"]] * m, pa.list_(pa.float64())), "ended": ([now["ended"]] * m, pa.bool_())}
        for c, (v, t) in new.items():
            part = part.set_column(part.column_names.index(c), c, pa.array(v, t))
        return part

    both = state.withColumn("out", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.select(*KEY, *names).schema)
    return cut(both.select(*KEY, *names, "out").groupBy(*KEY).applyInArrow(run, ddl))


def _started(rows: DataFrame, seed: int, columns: int) -> DataFrame:
    """A state: ``rows`` with a random first vector of norm 1 (of ``columns`` real columns)."""

    def run(part: pa.Table) -> pa.Table:
        part, m = part.sort_by("block"), len(part)
        x = np.vstack([normal(seed, columns, np.frombuffer(raw.as_py(), np.int64)) for raw in part.column("pos")])
        first, none = pa.array(_blocks(part, x / np.linalg.norm(x)), pa.binary()), pa.array([[]] * m, pa.list_(pa.float64()))
        for name, column in (("p", first), ("q_", pa.array([b""] * m, pa.binary())), ("x", first), ("alphas", none), ("betas", none), ("ended", pa.array([False] * m))):
            part = part.append_column(name, column)
        return part

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEY, *[c for c in rows.columns if c not in KEY]).schema)
    return cut(rows.select(*KEY, *[c for c in rows.columns if c not in KEY]).groupBy(*KEY).applyInArrow(run, f"{ddl}, p binary, q_ binary, x binary, alphas array<double>, betas array<double>, ended boolean"))


def _longest(rows: DataFrame) -> int:
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0


def _bidiagonal(iters: int) -> tuple[Callable[[dict], dict], Callable[[dict], dict]]:
    """Both halves of a round of bidiagonalization."""

    def down(now: dict) -> dict:
        if len(now["alphas"]) >= min(iters, len(now["p"])):
            return {"ended": True}
        r = now["out"][:, 1]
        if now["alphas"]:
            r = orthogonal(r - now["betas"][-1] * now["q_"][:, -1], now["q_"])
        alpha = float(np.linalg.norm(r))
        if alpha < BREAKDOWN:
            return {"ended": True}
        return {"q_": np.column_stack([now["q_"], r / alpha]), "x": (r / alpha)[:, None], "alphas": [*now["alphas"], alpha]}

    def up(now: dict) -> dict:
        s = orthogonal(now["out"][:, 0] - now["alphas"][-1] * now["p"][:, -1], now["p"])
        beta = float(np.linalg.norm(s))
        if beta < BREAKDOWN:
            return {"betas": [*now["betas"], beta], "ended": True}
        return {"p": np.column_stack([now["p"], s / beta]), "x": (s / beta)[:, None], "betas": [*now["betas"], beta]}

    return down, up


def _rounds(product: Product, pos: np.ndarray, iters: int, steps: list[Callable[[dict], dict]], seed: int, columns: int) -> dict:
    """The state of a window after at most ``iters`` rounds of ``steps``, all in one task."""
    x = normal(seed, columns, pos)
    x = x / np.linalg.norm(x)
    now = {"p": x, "q_": np.empty((len(x), 0)), "x": x, "alphas": [], "betas": [], "ended": False}
    for step in steps * min(iters, len(x)):
        now |= step(now | {"out": product(now["x"])})
        if now["ended"]:
            break
    return now


def golub_kahan(rows: DataFrame, iters: int, kernel: blocked.Kernel | None = None, seed: int = 7) -> DataFrame:
    """The state after ``iters`` rounds of bidiagonalization (fewer in windows of fewer tokens, or where a vector vanishes): bases ``p`` and ``q_`` with
    M q = p B, B lower bidiagonal with ``alphas`` and ``betas``.  ``kernel`` gives ``[M x, M' x]``."""
    down, up = _bidiagonal(iters)
    state, kernel = _started(rows, seed, 1), kernel or blocked.both_ways()
    for _ in range(min(iters, _longest(rows))):
        state = _step(_step(state, kernel, down), kernel, up)
    return state


def svd_by_lanczos(rows: DataFrame, k: int, iters: int | None = None, kernel: blocked.Kernel | None = None, seed: int = 7) -> DataFrame:
    """``block, n, sigmas, u, v``: the ``k`` largest singular values of each window and the blocks of their left and right vectors.  No rows for k <= 0."""
    if k <= 0:
        return _none(rows)
    iters, kernel = iters or max(2 * k + 2, 20), kernel or blocked.both_ways()

    def factors(alphas: list[float], betas: list[float], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        m = len(alphas)
        b = np.zeros((p.shape[1], m))
        b[range(m), range(m)] = alphas
        below = min(p.shape[1] - 1, m)
        b[range(1, below + 1), range(below)] = betas[:below]
        left, s, right = np.linalg.svd(b, full_matrices=False)
        return s[:k], [p @ left[:, :k], q @ right[:k].T]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        s, (u, v) = factors(part.column("alphas")[0].as_py(), part.column("betas")[0].as_py(), _vectors(part, "p"), _vectors(part, "q_"))
        return _pairs(part, s, u, v)

    def short(product: Product, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        now = _rounds(product, pos, iters, list(_bidiagonal(iters)), seed, 1)
        return factors(now["alphas"], now["betas"], now["p"], now["q_"])

    return _by_size(rows, kernel, short, lambda rows: golub_kahan(rows, iters, kernel, seed).groupBy(*KEY).applyInArrow(run, f"{KEY_DDL}, {_PAIRS}"), ["sigmas", "u", "v"])


_PAIRS = "block int, n int, sigmas array<double>, u binary, v binary"


def _pairs(part: pa.Table, s: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    return part.select([*KEY, "block", "n"]).append_column("sigmas", pa.array([s.tolist()] * len(part), pa.list_(pa.float64()))).append_column(
        "u", pa.array(_blocks(part, u), pa.binary())).append_column("v", pa.array(_blocks(part, v), pa.binary()))


def _none(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, "block", "n", F.array().cast("array<double>").alias("sigmas"), F.lit(b"").alias("u"), F.lit(b"").alias("v")).limit(0)


def window_sigmas(found: DataFrame) -> DataFrame:
    """``sigmas`` of each window."""
    return found.groupBy(*KEY).agg(F.any_value("sigmas").alias("sigmas"))


# -- random probes ----------------------------------------------------------------------------------------------------

def _triangle(x: DataFrame) -> DataFrame:
    """``r`` of each window: the triangular factor of its tall block of vectors, from the blocks' factors, FAN of them merged at a time."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.linalg.qr(unpacked(raw, n), mode="r") for raw, n in zip(batch.column("x").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), batch.column("block"), pa.array([r.shape[0] for r in out], pa.int32()), pa.array(list(map(packed, out)), pa.binary())],
                                             [*KEY, "block", "n", "r"])

    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        r = np.linalg.qr(_vectors(part, "r"), mode="r")
        return table_of([tuple(part.column(k)[0].as_py() for k in KEY)], {"block": (pa.int32(), [part.column("block")[0].as_py() // FAN]), "n": (pa.int32(), [len(r)]), "r": (pa.binary(), [packed(r)])})

    ddl = f"{KEY_DDL}, block int, n int, r binary"
    now, width = x.select(*KEY, "block", "n", "x").mapInArrow(factor, ddl), (x.agg(F.max("block")).first()[0] or 0) + 1
    while width > 1:
        now, width = now.withColumn("to", F.floor(F.col("block") / FAN)).groupBy(*KEY, "to").applyInArrow(lambda part: merge(part.drop_columns(["to"])), ddl), -(-width // FAN)
    return now.select(*KEY, F.col("n").alias("rn"), "r")


def _with_triangle(x: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A vector table of ``of(x, r)`` of each block."""
    return cut(blocked._mapped(x.join(_triangle(x), KEY), "y", lambda row: of(unpacked(row["x"], row["n"]), unpacked(row["r"], row["rn"])), ["x", "n", "r", "rn"]).select(
        *KEY, "block", "n", F.col("y").alias("x")))


def _scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    _, s, right = np.linalg.svd(r)
    s = np.r_[s, np.zeros(r.shape[1] - len(s))]
    some = s > 1e-11 * s[:1].sum()
    return x @ right.T * np.where(some, 1 / np.where(some, s, 1), 0.0)


def orthonormal(x: DataFrame) -> DataFrame:
    """The columns of ``x`` (key, block, n, x) made orthonormal, in two rounds; what depends on others becomes a zero column."""
    return _with_triangle(_with_triangle(x, _scaled), _scaled)


def _turned(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the triangular factor of M' Q: the ``k`` singular values, what turns Q into left vectors, and M' Q into right ones."""
    _, s, right = np.linalg.svd(r)
    s = s[:k]
    turn, some = right[: len(s)].T, s > 1e-12 * s[:1].sum()
    return s, turn, turn * np.where(some, 1 / np.where(some, s, 1), 0.0)


def randomized_svd(rows: DataFrame, k: int, more: int = 5, powers: int = 2, kernel: blocked.Kernel | None = None, seed: int = 7) -> DataFrame:
    """``block, n, sigmas, u, v`` like ``svd_by_lanczos``, by the range of M times ``k + more`` Gaussian probes after ``powers`` power rounds.  Probes beyond a window's tokens are not drawn."""
    if k <= 0:
        return _none(rows)
    kernel = kernel or blocked.both_ways()

    def short(product: Product, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        forth, back = (lambda x, at=at: np.hsplit(product(x), 2)[at] for at in (0, 1))
        clean = lambda x: _scaled(y := _scaled(x, np.linalg.qr(x, mode="r")), np.linalg.qr(y, mode="r"))
        y = clean(forth(normal(seed, min(k + more, len(pos)), pos)))
        for _ in range(powers):
            y = clean(forth(clean(back(y))))
        x = back(y)
        s, left, right = _turned(np.linalg.qr(x, mode="r"), k)
        return s, [y @ left, x @ right]

    return _by_size(rows, kernel, short, lambda rows: _randomized(rows, k, more, powers, kernel, seed), ["sigmas", "u", "v"])


def _randomized(rows: DataFrame, k: int, more: int, powers: int, kernel: blocked.Kernel, seed: int) -> DataFrame:
    """``randomized_svd`` of long windows."""
    size = rows.groupBy(*KEY).agg(F.sum("n").alias("tokens"))
    probes = lambda row: normal(seed, min(k + more, row["tokens"]), np.frombuffer(row["pos"], np.int64))
    x = cut(blocked._mapped(rows.join(size, KEY), "x", probes, ["pos", "tokens"]).select(*KEY, "block", "n", "x"))
    half = lambda y, back: blocked._mapped(blocked.product(rows, y, kernel=kernel), "x", lambda row: np.hsplit(unpacked(row["out"], row["n"]), 2)[back], ["out", "n"]).select(*KEY, "block", "n", "x")
    y = orthonormal(cut(half(x, 0)))
    for _ in range(powers):
        y = orthonormal(cut(half(orthonormal(cut(half(y, 1))), 0)))
    back = cut(half(y, 1))  # M' Q; its triangular factor has the singular values
    whole = y.withColumnRenamed("x", "y").join(back.select(*KEY, "block", "x"), [*KEY, "block"]).join(_triangle(back), KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigmas, us, vs = [], [], []
            for row in batch.select(["n", "x", "y", "rn", "r"]).to_pylist():
                s, left, right = _turned(unpacked(row["r"], row["rn"]), k)
                sigmas.append(s.tolist())
                us.append(packed(unpacked(row["y"], row["n"]) @ left))
                vs.append(packed(unpacked(row["x"], row["n"]) @ right))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "block", "n")), pa.array(sigmas, pa.list_(pa.float64())), pa.array(us, pa.binary()), pa.array(vs, pa.binary())],
                                             [*KEY, "block", "n", "sigmas", "u", "v"])

    return whole.mapInArrow(run, f"{KEY_DDL}, {_PAIRS}")


METHODS = {"randomized": randomized_svd, "lanczos": svd_by_lanczos}


# -- Hermitian --------------------------------------------------------------------------------------------------------

def magnetic(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The magnetic Laplacian of all score pairs times the complex vector ``x`` (real and imaginary column)."""
    s, t = blocked.scores(a, b), blocked.scores(b, a).T
    w, both = (abs(s) + abs(t)) / 2, s + t
    w = np.where(a.pos[:, None] == b.pos, 0.0, w)
    turned = w * np.exp(1j * np.where(both != 0, np.arctan((s - t) / np.where(both != 0, both, 1)), 0))
    for which, m, near, far, sums in ((0, turned, a, b, w.sum(1)), (1, turned.T.conj(), b, a, w.sum(0)))[: 1 if same else 2]:
        z = sums * (near.x[:, 0] + 1j * near.x[:, 1]) - m @ (far.x[:, 0] + 1j * far.x[:, 1])
        yield which, np.stack([z.real, z.imag], 1)


def hermitian_lanczos(rows: DataFrame, k: int = 1, iters: int = 20, smallest: bool = False, kernel: blocked.Kernel = magnetic, seed: int = 7) -> DataFrame:
    """``block, n, values, vectors``: the ``k`` largest or smallest eigenvalues of each window's Hermitian operator, and the blocks of their vectors (a real and an imaginary column
    each).  ``kernel`` gives the operator times ``x``."""
    empty = rows.select(*KEY, "block", "n", F.array().cast("array<double>").alias("values"), F.lit(b"").alias("vectors")).limit(0)
    if k <= 0:
        return empty

    def complex_(x: np.ndarray) -> np.ndarray:
        return x[:, ::2] + 1j * x[:, 1::2]

    def real(z: np.ndarray) -> np.ndarray:
        return np.stack([z.real, z.imag], 2).reshape(len(z), -1)

    def step(now: dict) -> dict:
        basis, z = complex_(now["p"]), complex_(now["out"])[:, 0]
        alpha = float(np.vdot(basis[:, -1], z).real)
        z = orthogonal(z, basis)
        beta = float(np.linalg.norm(z))
        alphas = [*now["alphas"], alpha]
        if beta < BREAKDOWN or len(alphas) >= min(iters, len(basis)):
            return {"alphas": alphas, "ended": True}
        return {"p": np.hstack([now["p"], real((z / beta)[:, None])]), "x": real((z / beta)[:, None]), "alphas": alphas, "betas": [*now["betas"], beta]}

    def ends(alphas: list[float], betas: list[float], p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
        values, vectors = np.linalg.eigh(t)
        at = np.arange(len(values))[:k] if smallest else np.arange(len(values))[::-1][:k]
        return values[at], [real(complex_(p)[:, : len(alphas)] @ vectors[:, at])]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        values, (found,) = ends(part.column("alphas")[0].as_py(), part.column("betas")[0].as_py(), _vectors(part, "p"))
        return part.select([*KEY, "block", "n"]).append_column("values", pa.array([values.tolist()] * len(part), pa.list_(pa.float64()))).append_column(
            "vectors", pa.array(_blocks(part, found), pa.binary()))

    def short(product: Product, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        now = _rounds(product, pos, iters, [step], seed, 2)
        return ends(now["alphas"], now["betas"], now["p"])

    def long(rows: DataFrame) -> DataFrame:
        state = _started(rows, seed, 2)
        for _ in range(min(iters, _longest(rows))):
            state = _step(state, kernel, step)
        return state.groupBy(*KEY).applyInArrow(run, f"{KEY_DDL}, block int, n int, values array<double>, vectors binary")

    return _by_size(rows, kernel, short, long, ["values", "vectors"])


def frustration(tok: DataFrame, iters: int = 20, size: int = blocked.SIZE) -> DataFrame:
    """The smallest eigenvalue of each window's magnetic Laplacian, not below 0."""
    found = hermitian_lanczos(cut(blocked.blocks(tok, size)), 1, iters, smallest=True)
    return found.groupBy(*KEY).agg(F.greatest(F.lit(0.0), F.any_value(F.get("values", F.lit(0)))).alias("frustration"))


def frustration_witness(tok: DataFrame, iters: int = 20, size: int = blocked.SIZE) -> DataFrame:
    """``i, witness``: the magnitudes of the bottom eigenvector."""
    rows = cut(blocked.blocks(tok, size))
    found = hermitian_lanczos(rows, 1, iters, smallest=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                x, n = unpacked(row["vectors"], row["n"]), row["n"]
                yield from table_of([tuple(row[k] for k in KEY)] * n, {"i": (pa.int32(), np.frombuffer(row["pos"], np.int64).tolist()), "witness": (pa.float64(), np.hypot(x[:, 0], x[:, 1]).tolist())}).to_batches()

    return found.join(rows.select(*KEY, "block", "pos"), [*KEY, "block"]).mapInArrow(run, f"{KEY_DDL}, i int, witness double")


# -- features ---------------------------------------------------------------------------------------------------------

def matrix_free(tok: DataFrame, rank: int = 4, method: str = "randomized", causal: bool = True, normalized: bool = True, probes: int = 10, seed: int = 42,
                size: int = blocked.SIZE, swept: bool = True) -> DataFrame:
    """``sigmas, sigma2, sigma2_asym, commutator_norm`` of each window, and of the routing operator (``swept``) ``phi_hat, g, gamma, c``; ``method`` names the factorization."""
    from attnlens.operators.signals import EPS, _split

    rows = blocked.attention(tok, causal, normalized, size)
    found = cut(METHODS[method](rows, max(rank, 2), kernel=blocked.both_ways(causal)))
    second = lambda df: F.coalesce(F.get(F.col(df), F.lit(1)), F.lit(0.0))
    skew = window_sigmas(METHODS[method](rows, 2, kernel=blocked.antisymmetric(causal))).select(*KEY, second("sigmas").alias("sigma2_asym"))
    sums = cut(blocked.squares(rows, causal))
    moved = blocked.commutator_estimate(rows, probes, seed, causal).select(*KEY, "c2")
    fro = F.sqrt("fro2")
    out = (window_sigmas(found).join(skew, KEY).join(sums, KEY).join(moved, KEY)
           .withColumns({"sigma2": second("sigmas"), "commutator_norm": F.sqrt("c2") / (fro + EPS)}))
    kept = [*KEY, F.slice("sigmas", 1, F.least(F.lit(max(rank, 2)), F.greatest(F.col("n") - 1, F.lit(0))).cast("int")).alias("sigmas"), "sigma2", "sigma2_asym", "commutator_norm"]
    if not swept:
        return out.select(*kept)
    pair = blocked._mapped(found, "x", lambda row: np.stack([unpacked(row[c], row["n"])[:, 1] if unpacked(row[c], row["n"]).shape[1] > 1 else np.zeros(row["n"]) for c in "uv"], 1), ["u", "v", "n"])
    phi = blocked.conductance(rows, pair.select(*KEY, "block", "x"), causal)
    return out.join(phi, KEY).select(*kept, F.when(F.col("n") > 1, F.col("phi_hat")).otherwise(0.0).alias("phi_hat"), *_split(F.col("fro2"), F.col("sym"), F.col("r2"), F.col("n")))
