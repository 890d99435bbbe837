"""Windows, dataset preparation and label analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnlens.sources.shared import cut

#: Keys with more rows than this are numbered in ranges.
HOT = 100_000


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "at", hot: int = HOT, parts: int = 64) -> DataFrame:
    """``rows`` with a bigint column ``into``: each row's number from 1 among those of its key, in ``order``.

    The rows of a key that has more than ``hot`` are dealt to ranges of the first order column, numbered in each, and moved on by the rows of
    the ranges before.  Rows equal in that column share a range.  Null keys are one key; nulls come first."""
    first = F.col(order[0])
    cuts = F.percentile_approx(first, [k / parts for k in range(1, parts)], 10_000).alias("_cuts")
    renamed = [F.col(c).alias(f"_{c}") for c in by]
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*renamed)
    # quantiles of large keys alone; found once, since approximate ones differ with the order in which parts are merged, and both uses below must agree
    large = cut(rows.join(large, same, "left_semi").groupBy(*by).agg(cuts).select(*renamed, "_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < first)), F.lit(0))
    placed = rows.join(large, same, "left").withColumn("_part", part).drop(*[f"_{c}" for c in by])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.where(F.col("_cuts").isNotNull()).groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select(*renamed, F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return (placed.drop("_cuts").withColumn(into, inside).join(offsets, [*same, F.col("_part") == F.col("_p")], "left")
            .withColumn(into, F.col(into) + F.coalesce("_before", F.lit(0))).select(*rows.columns, into))


def tumbling(events: DataFrame, key: str, order: list[str], width: int, hot: int = HOT) -> DataFrame:
    """Disjoint count windows of ``width`` rows; a trailing part never fires."""
    rows = numbered(events.select(key, *order, "value"), [key], order, hot=hot).withColumn("window_id", F.floor((F.col("at") - 1) / width))
    return rows.groupBy(key, "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).where(F.col("n") == width)


def sliding(events: DataFrame, key: str, order: list[str], width: int, interval: int) -> DataFrame:
    """The last ``width`` rows at every ``interval``-th row."""
    w = Window.partitionBy(key).orderBy(*order)
    last = w.rowsBetween(-(width - 1), 0)
    rows = events.select(key, F.row_number().over(w).alias("step"), F.count(F.lit(1)).over(last).alias("n"), F.sum("value").over(last).alias("total"))
    return rows.where((F.col("step") % interval == 0) & (F.col("n") >= 2))


def hash_unit(key: Column) -> Column:
    """[0, 1) from the first 16 hexadecimal digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def hash_split(rows: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    return rows.where(hash_unit(F.col(key)) >= least)


def balanced(rows: DataFrame, label: str, order: str, hot: int = HOT) -> DataFrame:
    """The first rows of each class, as many as the smaller class has."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return numbered(rows, [label], [order], hot=hot).join(F.broadcast(n)).where("at <= least").drop("at", "least")


def correlation(rows: DataFrame, by: list[str], x: str, label: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.corr(F.col(label).cast("double"), F.col(x)).alias("r"),
                                 F.countDistinct(label).alias("classes")).where("n >= 10 and classes = 2").drop("classes")


def rank_sums(rows: DataFrame, by: list[str], x: str, label: str, parts: int = 64) -> DataFrame:
    """``ranks, n, n1`` of each group: the mid-ranks of the rows labelled 1, summed, and the counts of all rows and of those.

    Equal values are counted first; groups of values are then ranked in ``parts`` ranges with running counts between them, so no task holds
    all values of a group."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("long")).alias("c1"))
    cuts = cut(counts.groupBy(*by).agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 10_000).alias("cuts")))  # found once, as in ``numbered``
    placed = counts.join(cuts, by).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(x)))).drop("cuts")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "part").agg(F.sum("c").alias("n")).select(*by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(sums, [*by, "part"]).withColumn("mid", F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0)) + (F.col("c") + 1) / 2)
    return ranked.groupBy(*by).agg(F.sum(F.col("mid") * F.col("c1")).alias("ranks"), F.sum("c").alias("n"), F.sum("c1").alias("n1"))


def auroc(rows: DataFrame, by: list[str], x: str, label: str) -> DataFrame:
    """Mann-Whitney on mid-ranks."""
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return rank_sums(rows.where(F.col(label).isNotNull()), by, x, label).where((n1 > 0) & (n0 > 0)).select(
        *by, ((F.col("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))


def quartiles(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    q = F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return rows.groupBy(*by).agg(q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


def histogram(rows: DataFrame, by: str, x: str, bins: int) -> DataFrame:
    """``by, bin, n``: ``bins`` equal parts between a group's least and largest value; empty parts have no row."""
    ends = rows.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    part = F.least(F.floor((F.col(x) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    at = rows.join(ends, by).withColumn("bin", F.when(F.col("high") > F.col("low"), part).otherwise(0).cast("int"))
    return at.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def _auroc(x: np.ndarray, label: np.ndarray) -> float:
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    mid = np.cumsum(n) - (n - 1) / 2
    n1 = int(label.sum())
    return float((mid[at][label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(x) - n1)))


def bootstrap_auroc(rows: DataFrame, by: str, order: str, x: str, label: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """AUROC of each group and the 2.5 and 97.5 percentiles over resamples; null where a group has one class, resamples of one class do not count.

    A group is one feature's column of labelled samples, in the order of ``order``."""

    def limits(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        v, y = part.column(x).to_numpy(), part.column(label).to_numpy()
        found = None, None, None
        if 0 < y.sum() < len(y):
            draw, seen = np.random.RandomState(seed), []
            for _ in range(resamples):
                at = draw.randint(0, len(y), len(y))
                if 0 < y[at].sum() < len(y):
                    seen.append(_auroc(v[at], y[at]))
            found = _auroc(v, y), *(map(float, np.percentile(seen, [2.5, 97.5])) if seen else (None, None))
        return pa.table({by: part.column(by)[:1], **{c: pa.array([f], pa.float64()) for c, f in zip(("auroc", "low", "high"), found, strict=True)}})

    kind = rows.schema[by].dataType.simpleString()
    return rows.where(F.col(x).isNotNull() & F.col(label).isNotNull()).select(by, order, x, label).groupBy(by).applyInArrow(limits, f"{by} {kind}, auroc double, low double, high double")
