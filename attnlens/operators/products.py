"""Products of an edge relation with vectors: no matrix is built, a product is a join on one end and a sum by the other.

A vector is a table of the key, ``node`` and ``x``; a product is one too.  Entries that no edge reaches are 0 and have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.functions.arrays import dot
from attnlens.sources.tokens import DIMS, KEY


def times(e: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """``M x`` of the edges' ``p``, or ``M' x``."""
    near, far = ("i", "j") if not transposed else ("j", "i")
    at = x.select(*KEY, F.col("node").alias(far), "x")
    return e.join(at, [*KEY, far]).groupBy(*KEY, F.col(near).alias("node")).agg(F.sum(F.col("p") * F.col("x")).alias("x"))


def both_ways(e: DataFrame, x: DataFrame) -> DataFrame:
    """``M x`` and ``M' x`` as ``x, xt`` from one pass over the edges."""
    i, j = (x.select(*KEY, F.col("node").alias(end), F.col("x").alias(f"x{end}")) for end in ("i", "j"))
    halves = e.join(i, [*KEY, "i"], "left").join(j, [*KEY, "j"], "left").select(*KEY, F.explode(F.array(
        F.struct(F.col("i").alias("node"), (F.col("p") * F.coalesce("xj", F.lit(0.0))).alias("x"), F.lit(0.0).alias("xt")),
        F.struct(F.col("j").alias("node"), F.lit(0.0).alias("x"), (F.col("p") * F.coalesce("xi", F.lit(0.0))).alias("xt")))).alias("v"))
    return halves.groupBy(*KEY, "v.node").agg(F.sum("v.x").alias("x"), F.sum("v.xt").alias("xt"))


def antisymmetric(e: DataFrame, x: DataFrame) -> DataFrame:
    """``(M - M') / 2 x``."""
    return both_ways(e, x).select(*KEY, "node", ((F.col("x") - F.col("xt")) / 2).alias("x"))


def symmetric(e: DataFrame, x: DataFrame) -> DataFrame:
    """``(M + M') / 2 x``."""
    return both_ways(e, x).select(*KEY, "node", ((F.col("x") + F.col("xt")) / 2).alias("x"))


def commutator(e: DataFrame, x: DataFrame) -> DataFrame:
    """The commutator of the symmetric and antisymmetric parts times x, which is ``(M'M - MM') x / 2``."""
    once = both_ways(e, x)
    down = times(e, once.select(*KEY, "node", "x"), transposed=True)
    up = times(e, once.select(*KEY, "node", F.col("xt").alias("x")))
    signed = down.unionByName(up.withColumn("x", -F.col("x")))
    return signed.groupBy(*KEY, "node").agg((F.sum("x") / 2).alias("x"))


def scores_times(tok: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """``Q (K' x)``, or ``K (Q' x)``: a sum of vectors of the width of a token per key, then a dot product per token; no pair of tokens meets."""
    first, second = ("k", "q") if not transposed else ("q", "k")
    weighted = tok.join(x.withColumnRenamed("node", "pos"), [*KEY, "pos"])
    sums = weighted.groupBy(*KEY).agg(F.array(*[F.sum(F.get(first, F.lit(c)) * F.col("x")) for c in range(DIMS)]).alias("sums"))
    return tok.join(sums, KEY).select(*KEY, F.col("pos").alias("node"), dot(second, "sums").alias("x"))


def asked_entries(tok: DataFrame, asked: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The entries (key, i, j) of ``asked`` of the degree-normalized causal attention from both tokens, the row's log-sum-exp (``i, lse``) and
    the column's degree (``j, degree``): no other entry is made.  One of a token that is not there is 0."""
    found = (asked.join(tok.select(*KEY, F.col("pos").alias("i"), "q"), [*KEY, "i"], "left").join(tok.select(*KEY, F.col("pos").alias("j"), "k"), [*KEY, "j"], "left")
             .join(rows, [*KEY, "i"], "left").join(columns, [*KEY, "j"], "left"))
    p = F.exp(dot("q", "k") / DIMS ** 0.5 - F.col("lse"))
    return found.select(*KEY, "i", "j", F.when((F.col("j") <= F.col("i")) & F.col("lse").isNotNull() & (F.col("degree") > 1e-10), p / F.sqrt("degree")).otherwise(0.0).alias("p"))
