"""The label report of a feature: correlation with its p, AUROC, guards, best layer, spread."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnlens.operators.analysis import rank_sums

LEAST, LEAST_OF_CLASS = 10, 3


def two_sided_p(r: float | None, n: int) -> float | None:
    """P of a correlation at least as strong between unrelated values: the regularized incomplete beta function of 1 - r^2 at (n / 2 - 1, 1 / 2)."""
    if r is None or math.isnan(r) or n < 3:
        return None
    x, a, b = 1 - r * r, n / 2 - 1, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, from its end to its beginning."""
    value = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    return 1 / (1 - (a + b) / (a + 1) * x / value)


def p_value(r: str, n: str) -> Column:
    def of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return F.pandas_udf(of, "double")(r, n)


def class_counts(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``n, positive, negative, classes`` of each group, and whether both classes have LEAST_OF_CLASS rows."""
    out = rows.groupBy(*by).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("positive"), F.countDistinct(label).cast("int").alias("classes"))
    negative = F.col("n") - F.col("positive")
    return out.withColumn("negative", negative).withColumn("enough", F.least("positive", negative) >= LEAST_OF_CLASS)


def value_auroc(rows: DataFrame, by: list[str], x: str, label: str) -> DataFrame:
    """AUROC of each group, 0.5 where it has fewer than LEAST rows or one class."""
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    enough = (F.col("n") >= LEAST) & (n1 > 0) & (n0 > 0)
    return rank_sums(rows, by, x, label).select(*by, "n", F.when(enough, F.try_divide(F.col("ranks") - n1 * (n1 + 1) / 2, n1 * n0)).otherwise(0.5).alias("auroc"))


def signal_report(rows: DataFrame, sample: str, layer: str, feature: str, x: str, label: str) -> DataFrame:
    """``feature, layer, n, r, auroc`` of every layer and of each sample's mean over its layers (layer ALL)."""
    each = rows.where(F.col(x).isNotNull()).select(sample, feature, F.col(layer).cast("string").alias("layer"), x, label)
    means = each.groupBy(sample, feature).agg(F.round(F.avg(x), 9).alias(x), F.min(label).alias(label)).withColumn("layer", F.lit("ALL"))
    both = each.unionByName(means)
    y = F.col(label).cast("double")  # a constant feature has no correlation
    r = both.groupBy(feature, "layer").agg(F.count(x).alias("n"), F.try_divide(F.covar_pop(y, F.col(x)), F.stddev_pop(y) * F.stddev_pop(x)).alias("r"),
                                          F.countDistinct(label).alias("classes"))
    r = r.withColumn("r", F.when((F.col("n") >= LEAST) & (F.col("classes") == 2), F.col("r"))).drop("classes")
    return r.join(value_auroc(both, [feature, "layer"], x, label).drop("n"), [feature, "layer"], "left").select(feature, "layer", "n", "r", F.coalesce("auroc", F.lit(0.5)).alias("auroc"))


def best_layers(report: DataFrame, feature: str) -> DataFrame:
    """Of each feature the layer of the strongest correlation and that of the AUROC farthest from 0.5; of equal ones the first."""
    single = report.where("layer != 'ALL'").withColumns({"by_r": F.round(F.abs(F.coalesce("r", F.lit(0.0))), 9), "by_auroc": F.round(F.abs(F.col("auroc") - 0.5), 9)})
    first = -F.col("layer").cast("int")
    pick = lambda c: F.max_by(F.struct("layer", "r", "auroc"), F.struct(F.col(c), first))
    best = single.groupBy(feature).agg(pick("by_r").alias("a"), pick("by_auroc").alias("b"))
    return best.select(feature, F.col("a.layer").alias("layer_by_r"), F.col("a.r").alias("r"), F.col("b.layer").alias("layer_by_auroc"), F.col("b.auroc").alias("auroc"))


def whiskers(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Quartiles, and the range of the values within 1.5 times their distance of them."""
    q = F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    box = rows.groupBy(*by).agg(q.alias("q"), F.min(x).alias("least"), F.max(x).alias("most"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    return box.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"),
                      F.greatest(F.col("least"), F.col("q")[0] - reach).alias("low"), F.least(F.col("most"), F.col("q")[2] + reach).alias("high"))
