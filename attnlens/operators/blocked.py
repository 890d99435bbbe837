"""Products of attention with vectors from blocks of tokens: no edge table and no matrix of a window, only blocks of ``size`` x ``size`` weights, made anew in every pass.

Tokens of a window of one head are packed into blocks.  A pass pairs each block with itself and the blocks before it, one row a pair, so a window's pairs spread over tasks by
(key, later block); a kernel makes the weights of a pair, turns them into contributions to both blocks, and contributions to a block are merged.  Vectors are
tables of (key, block) with the block's rows of one or more columns.

Weights: ``softmax`` of the scores by their row's log-sum-exp, times ``d`` of the column: 1, or the column's degree to the power -1/2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.sources.shared import cut
from attnlens.sources.tokens import KEY

SIZE = 256
#: A column of a smaller degree has no weight.
LEAST_DEGREE = 1e-10
KEY_DDL = "request_id bigint, layer_idx int, head int"
_OUT = f"{KEY_DDL}, block int, n int, out binary"
#: Blocks whose contributions a task keeps.
HELD = 2_000
_KEY_TYPES = (pa.int64(), pa.int32(), pa.int32())


def table_of(keys: list[tuple], columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    """Rows of ``keys`` (request, layer, head) and further columns."""
    out = {k: pa.array([x[i] for x in keys], t) for i, (k, t) in enumerate(zip(KEY, _KEY_TYPES, strict=True))}
    return pa.table(out | {c: pa.array(v, t) for c, (t, v) in columns.items()})


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """A block of vectors: ``n`` rows, a column for each vector."""
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def blocks(tok: DataFrame, size: int = SIZE) -> DataFrame:
    """``block, last, n, pos, q, k``: the tokens of each window of one head, ``size`` in a block; ``last`` is the window's last block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of one block
        done: list[tuple] = []

        def end() -> None:
            done.append((held[0][0], *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))))
            held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            columns = {"block": (pa.int32(), [x[0][3] for x in done]), "n": (pa.int32(), [len(x[1]) for x in done])}
            columns |= {c: (pa.binary(), [x[i].tobytes() for x in done]) for i, c in ((1, "pos"), (2, "q"), (3, "k"))}
            yield from table_of([x[0] for x in done], columns).to_batches()
            done.clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*KEY, "block")], 1)
            pos, (q, k) = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64), (batch.column(c) for c in "qk")
            flat = lambda x, a, b: x.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if held and held[0][0] != key:
                    end()
                held.append((key, pos[a:b], flat(q, a, b), flat(k, a, b)))
            yield from rows()
        if held:
            end()
            yield from rows()

    at = tok.select(*KEY, "pos", "q", "k", F.floor(F.col("pos") / size).cast("int").alias("block"))
    # rows in order, and not a group of Arrow's for each block, which costs more than the block where windows are short
    rows = at.repartition(*KEY, "block").sortWithinPartitions(*KEY, "block", "pos").mapInArrow(pack, f"{KEY_DDL}, block int, n int, pos binary, q binary, k binary")
    last = at.groupBy(*KEY).agg(F.max("block").alias("last"))
    return rows.join(last, KEY)


@dataclass(frozen=True)
class Side:
    """One block of a pair, as arrays."""

    pos: np.ndarray
    q: np.ndarray
    k: np.ndarray
    lse: np.ndarray | None
    d: np.ndarray | None
    x: np.ndarray | None


Kernel = Callable[[Side, Side, bool], Iterator[tuple[int, np.ndarray]]]


def scores(a: Side, b: Side) -> np.ndarray:
    return a.q @ b.k.T / a.q.shape[1] ** 0.5


def weights(a: Side, b: Side, causal: bool) -> np.ndarray:
    """The weights of rows ``a`` and columns ``b``."""
    out = np.exp(scores(a, b) - a.lse[:, None]) * b.d
    return np.where(b.pos <= a.pos[:, None], out, 0.0) if causal else out


def contributions(rows: DataFrame, kernel: Kernel, merge: np.ufunc = np.add) -> DataFrame:
    """``block, n, out``: what ``kernel(later, earlier, same)`` gives to the later (0) and the earlier (1) block, merged inside each task.

    ``rows`` has the columns of ``blocks`` and, where the kernel wants them, ``lse``, ``d`` and ``x``."""
    names = [c for c in ("pos", "q", "k", "lse", "d", "x") if c in rows.columns]
    left = rows.select(*KEY, "block", F.col("n").alias("n0"), *[F.col(c).alias(f"{c}0") for c in names])
    right = rows.select(*KEY, F.explode(F.sequence("block", "last")).alias("block"), F.col("block").alias("earlier"), F.col("n").alias("n1"), *[F.col(c).alias(f"{c}1") for c in names])

    def side(row: dict, s: int) -> Side:
        vectors = {c: unpacked(row[f"{c}{s}"], row[f"n{s}"]) if c in names else None for c in ("q", "k", "x")}
        lists = {c: np.frombuffer(row[f"{c}{s}"], np.float64) if c in names else None for c in ("lse", "d")}
        return Side(pos=np.frombuffer(row[f"pos{s}"], np.int64), **vectors, **lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            yield from table_of([k for k, _ in found], {"block": (pa.int32(), [b for _, b in found]), "n": (pa.int32(), list(map(len, found.values()))),
                                                        "out": (pa.binary(), list(map(packed, found.values())))}).to_batches()
            found.clear()

        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                key, ends = tuple(row[k] for k in KEY), (row["block"], row["earlier"])
                for which, part in kernel(side(row, 0), side(row, 1), ends[0] == ends[1]):
                    to = (key, ends[which])
                    found[to] = merge(found[to], part) if to in found else part
                if len(found) > HELD:
                    yield from rows()
        yield from rows()

    return left.join(right, [*KEY, "block"]).mapInArrow(run, _OUT)


def over_pairs(rows: DataFrame, kernel: Kernel, merge: np.ufunc = np.add) -> DataFrame:
    """``contributions``, one row a block."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done = None, None, []

        def rows() -> Iterator[pa.RecordBatch]:
            yield from table_of([x[0] for x in done], {"block": (pa.int32(), [x[0][3] for x in done]), "n": (pa.int32(), [x[0][4] for x in done]), "out": (pa.binary(), [packed(x[1]) for x in done])}).to_batches()
            done.clear()

        for batch in batches:
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in (*KEY, "block", "n")), batch.column("out"), strict=True):
                x = unpacked(raw.as_py(), key[4])
                if key == now:
                    total = merge(total, x)
                else:
                    done += [] if now is None else [(now, total)]
                    now, total = key, x
            yield from rows()
        done += [] if now is None else [(now, total)]
        yield from rows()

    return contributions(rows, kernel, merge).repartition(*KEY, "block").sortWithinPartitions(*KEY, "block").mapInArrow(whole, _OUT)


def attention(tok: DataFrame, causal: bool = True, normalized: bool = True, size: int = SIZE) -> DataFrame:
    """The blocks of ``tok`` with what makes their weights: ``lse`` of each row and ``d`` of each column."""

    def lse(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        for which, (rows, columns) in enumerate(((a, b), (b, a))[: 1 if causal or same else 2]):
            s = scores(rows, columns)
            if causal:
                s = np.where(columns.pos <= rows.pos[:, None], s, -np.inf)
            yield which, np.logaddexp.reduce(s, axis=1, keepdims=True)

    def degree(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        for which, (rows, columns) in enumerate(((a, b), (b, a))[: 1 if causal or same else 2]):
            yield 1 - which, weights(rows, columns, causal).sum(0)[:, None]

    base = cut(blocks(tok, size))
    rows = base.join(over_pairs(base, lse, np.logaddexp).select(*KEY, "block", F.col("out").alias("lse")), [*KEY, "block"])
    one = _mapped(rows, "d", lambda row: np.ones(row["n"]), ["n"])
    if not normalized:
        return cut(one)
    one = cut(one)
    degrees = over_pairs(one, degree).select(*KEY, "block", F.col("out").alias("degree"))

    def root(row: dict) -> np.ndarray:
        x = np.frombuffer(row["degree"], np.float64)
        return np.where(x > LEAST_DEGREE, 1 / np.sqrt(np.maximum(x, LEAST_DEGREE)), 0.0)

    return cut(_mapped(one.drop("d").join(degrees, [*KEY, "block"]), "d", root, ["degree"]).drop("degree"))


def _mapped(rows: DataFrame, into: str, of: Callable[[dict], np.ndarray], inputs: list[str]) -> DataFrame:
    """``rows`` with a binary column ``into`` made from each row's ``inputs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [packed(of(row)) for row in batch.select(inputs).to_pylist()]
            yield batch.append_column(into, pa.array(out, pa.binary()))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{ddl}, {into} binary")


def both_ways(causal: bool = True) -> Kernel:
    """The columns ``x`` of a block to ``M x`` and ``M' x``, side by side."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        for which, (r, c) in enumerate(((a, b), (b, a))[: 1 if causal or same else 2]):
            m = weights(r, c, causal)
            forth, back = m @ c.x, m.T @ r.x
            yield which, np.hstack([forth, np.zeros_like(forth)])
            yield 1 - which, np.hstack([np.zeros_like(back), back])

    return kernel


def antisymmetric(causal: bool = True) -> Kernel:
    """``A x`` and ``A' x`` of the antisymmetric part A of M."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        for which, part in both_ways(causal)(a, b, same):
            forth, back = np.hsplit(part, 2)
            yield which, np.hstack([(forth - back) / 2, (back - forth) / 2])

    return kernel


def product(rows: DataFrame, x: DataFrame, causal: bool = True, kernel: Kernel | None = None) -> DataFrame:
    """``block, n, out`` of the columns of ``x`` (key, block, x): first ``M x``, then ``M' x``."""
    return over_pairs(rows.join(x.select(*KEY, "block", "x"), [*KEY, "block"]), kernel or both_ways(causal))


def vectors_of(rows: DataFrame, values: str) -> DataFrame:
    """A vector table of lists of numbers, row after row."""
    return _mapped(rows.select(*KEY, "block", values), "x", lambda row: np.array(row[values], np.float64), [values]).drop(values)


def signs(seed: int, probes: int, pos: np.ndarray) -> np.ndarray:
    """Probes of +1 and -1: whether the first digit of the MD5 of ``seed:probe:pos`` is below 8."""
    return np.array([[1.0 if hashlib.md5(f"{seed}:{c}:{p}".encode()).hexdigest()[0] < "8" else -1.0 for c in range(probes)] for p in pos.tolist()]).reshape(len(pos), probes)


def sign_probes(rows: DataFrame, probes: int, seed: int) -> DataFrame:
    """A vector table of ``probes`` columns of signs, the same for every window."""
    return _mapped(rows.select(*KEY, "block", "pos"), "x", lambda row: signs(seed, probes, np.frombuffer(row["pos"], np.int64)), ["pos"]).drop("pos")


def split(found: DataFrame, by: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A vector table of ``by`` of each block of ``out``."""
    return _mapped(found, "x", lambda row: by(unpacked(row["out"], row["n"])), ["out", "n"]).select(*KEY, "block", "x")


def squares(rows: DataFrame, causal: bool = True) -> DataFrame:
    """``fro2, sym, r2, n`` of each window: the squared norm of M, <M, M'>, the squared norm of the row sums of its antisymmetric part, the number of tokens."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        m = weights(a, b, causal)
        t = m if same else np.zeros_like(m).T if causal else weights(b, a, causal)
        r = [(m.sum(1) - t.sum(0)) / 2, (t.sum(1) - m.sum(0)) / 2]
        sums = [(m * m).sum() + (0 if same else (t * t).sum()), (m * t.T).sum() * (1 if same else 2)]
        for which in (0,) if same else (0, 1):
            out = np.zeros((len(r[which]), 3))
            out[:, 2] = r[which]
            if not which:
                out[0, :2] = sums
            yield which, out

    def total(row: dict) -> np.ndarray:
        x = unpacked(row["out"], row["n"])
        return np.array([x[:, 0].sum(), x[:, 1].sum(), (x[:, 2] ** 2).sum()])

    return _totals(over_pairs(rows, kernel), total, ["fro2", "sym", "r2"])


def _totals(found: DataFrame, of: Callable[[dict], np.ndarray], names: list[str]) -> DataFrame:
    """Sums of each window's ``of`` over its blocks, and its tokens ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([of(row) for row in batch.select(["n", "out"]).to_pylist()]).reshape(len(batch), len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), batch.column("n"), *(pa.array(sums[:, i], pa.float64()) for i in range(len(names)))], [*KEY, "n", *names])

    parts = found.mapInArrow(run, f"{KEY_DDL}, n int, {', '.join(f'{c} double' for c in names)}")
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in names], F.sum("n").alias("n"))


def asymmetry_probes(rows: DataFrame, probes: int = 10, seed: int = 42, causal: bool = True) -> DataFrame:
    """``block, n, out``: of each token the mean square of its row of ``(M - M') / 2`` times the sign probes; over a window they sum to an unbiased
    estimate of the squared norm of the antisymmetric part."""
    found = product(rows, sign_probes(rows, probes, seed), causal)
    half = lambda x: ((x[:, : x.shape[1] // 2] - x[:, x.shape[1] // 2 :]) / 2) ** 2
    return _mapped(found, "mass", lambda row: half(unpacked(row["out"], row["n"])).mean(1), ["out", "n"]).drop("out").withColumnRenamed("mass", "out")


def asymmetry_estimate(rows: DataFrame, probes: int = 10, seed: int = 42, causal: bool = True) -> DataFrame:
    """``s_asym, n`` of each window by ``asymmetry_probes``."""
    return _totals(asymmetry_probes(rows, probes, seed, causal), lambda row: np.array([np.frombuffer(row["out"], np.float64).sum()]), ["s_asym"])


def commutator_estimate(rows: DataFrame, probes: int = 10, seed: int = 42, causal: bool = True) -> DataFrame:
    """``c2, n``: an unbiased estimate of the squared norm of the commutator of the symmetric and antisymmetric parts, ``(M'M - MM') / 2``, from sign probes in two passes."""
    once = cut(split(product(rows, sign_probes(rows, probes, seed), causal), lambda x: x))  # [M z, M' z]
    twice = product(rows, once, causal)  # [M M z, M M' z, M' M z, M' M' z]

    def square(row: dict) -> np.ndarray:
        x = unpacked(row["out"], row["n"])
        m = x.shape[1] // 4
        return np.array([(((x[:, 2 * m : 3 * m] - x[:, m : 2 * m]) / 2) ** 2).sum() / m])

    return _totals(twice, square, ["c2"])


def conductance(rows: DataFrame, vectors: DataFrame, causal: bool = True, clear: float = 0.1, eps: float = 1e-12) -> DataFrame:
    """``phi_hat`` of each window from the sweep along ``vectors`` (key, block, x: left and right values of a token), with no edge table.

    The nodes of both sides stand in the order of their values, (value, side, token); each beginning is a set, and its cut follows from what the edges of each node add when it
    joins.  The values' unweighted means give the direction; without a clear mean the better of both directions counts; the result is between 0 and 1."""

    def ranks(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        x = np.vstack([unpacked(raw.as_py(), n.as_py()) for raw, n in zip(part.column("x"), part.column("n"), strict=True)])
        mean = float(x.mean(0).sum())
        values = (x if mean >= 0 else -x).T.ravel()
        place = np.empty(len(values))
        place[np.argsort(values, kind="stable")] = np.arange(len(values))
        place, at, out = place.reshape(2, -1).T, 0, []
        for n in part.column("n").to_pylist():
            out.append(packed(place[at : at + n]))
            at += n
        return part.select([*KEY, "block"]).append_column("x", pa.array(out, pa.binary())).append_column("mean", pa.array([abs(mean)] * len(part), pa.float64()))

    placed = cut(rows.select(*KEY, "block", "n").join(vectors.select(*KEY, "block", "x"), [*KEY, "block"]).groupBy(*KEY).applyInArrow(
        ranks, f"{KEY_DDL}, block int, x binary, mean double"))

    def kernel(a: Side, b: Side, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        for which, (r, c) in enumerate(((a, b), (b, a))[: 1 if causal or same else 2]):
            m = weights(r, c, causal)
            first = np.where(r.x[:, :1] < c.x[:, 1], m, -m)  # an edge is cut from its first end's place on, up to its last one's
            zero = lambda n: np.zeros(n)
            yield which, np.stack([first.sum(1), m.sum(1), zero(len(m)), zero(len(m))], 1)
            yield 1 - which, np.stack([zero(m.shape[1]), zero(m.shape[1]), -first.sum(0), m.sum(0)], 1)

    moved = over_pairs(rows.join(placed.select(*KEY, "block", "x"), [*KEY, "block"]), kernel)

    def least(cut_: np.ndarray, volume: np.ndarray, whole: float) -> float:
        smaller = np.minimum(volume, whole - volume)
        some = smaller > eps
        return float((cut_[some] / smaller[some]).min()) if some.any() else 1.0

    def sweep(part: pa.Table) -> pa.Table:
        read = lambda c: np.vstack([unpacked(raw.as_py(), n.as_py()) for raw, n in zip(part.column(c), part.column("n"), strict=True)])
        place, out = read("x").T.ravel().astype(np.int64), read("out")
        delta, degree = np.empty(len(place)), np.empty(len(place))
        delta[place], degree[place] = np.r_[out[:, 0], out[:, 2]], np.maximum(np.r_[out[:, 1], out[:, 3]], eps)
        phi = 0.0
        if (out[:, 1].sum() > eps):
            phi = least(np.cumsum(delta), np.cumsum(degree), degree.sum())
            if not (phi >= 0 and part.column("mean")[0].as_py() > clear):
                phi = min(phi, least(np.cumsum(-delta[::-1]), np.cumsum(degree[::-1]), degree.sum()))
        return table_of([tuple(part.column(k)[0].as_py() for k in KEY)], {"phi_hat": (pa.float64(), [max(0.0, min(phi, 1.0))])})

    return moved.join(placed, [*KEY, "block"]).groupBy(*KEY).applyInArrow(sweep, f"{KEY_DDL}, phi_hat double")
