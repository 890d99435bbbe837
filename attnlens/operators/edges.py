"""Attention as an edge relation ``(key, i, j, weight)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnlens.functions.arrays import dot
from attnlens.sources.tokens import DIMS, KEY


#: Token pairs of a task, and the least that a task is worth where cores are idle.
PAIRS, FEW_PAIRS = 250_000, 20_000


def dealt(tok: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``tok`` dealt by ``key`` to as many tasks as its pairs ask for.  Pairs are made and sorted where their tokens lie, and tokens are few beside them: without a number of tasks
    Spark merges small partitions of tokens, and a task's pairs grow with the table."""
    sizes = tok.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    cores = tok.sparkSession.sparkContext.defaultParallelism
    return tok.repartition(max(-(-n // PAIRS), min(cores, n // FEW_PAIRS), 1), *key)


def scores(tok: DataFrame, causal: bool, scale: bool = True, key: list[str] = KEY) -> DataFrame:
    """Scores of token pairs of one key; ``causal`` prunes the pairs inside the join instead of masking them."""
    tok = dealt(tok, key)
    a = tok.select(*key, F.col("pos").alias("i"), "q")
    b = tok.select(*key, F.col("pos").alias("j"), "k")
    pairs = a.join(b, key).where("j <= i") if causal else a.join(b, key)
    return pairs.select(*key, "i", "j", (dot("q", "k") / (DIMS ** 0.5 if scale else 1.0)).alias("s"))


def attention(tok: DataFrame, causal: bool = True, key: list[str] = KEY) -> DataFrame:
    """Row-stochastic weights ``p``: a stable softmax whose two window aggregates share one exchange."""
    row = Window.partitionBy(*key, "i")
    e = scores(tok, causal, key=key).withColumn("x", F.exp(F.col("s") - F.max("s").over(row)))
    return e.withColumn("p", F.col("x") / F.sum("x").over(row)).select(*key, "i", "j", "s", "p")


def normalized(p: DataFrame, eps: float = 1e-10) -> DataFrame:
    """``p`` divided by the root of its key's degree (the row degree is 1); 0 where the degree vanishes."""
    d = F.sum("p").over(Window.partitionBy(*KEY, "j"))
    return p.select(*KEY, "i", "j", F.when(d > eps, F.col("p") / F.sqrt(d)).otherwise(0.0).alias("p"))
