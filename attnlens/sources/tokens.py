"""Token vectors and labelled samples from the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["request_id", "layer_idx", "head"]
DIMS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    """One row per (request, layer, head, position) with ``q`` and ``k``: ``length`` tokens a request, 2 layers x 2 heads."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, range(4)))).alias("s"))
    part = lambda at: F.transform(F.slice("embedding", F.col("s") * 16 + at, DIMS), lambda x: x.cast("double") * 8)
    return rows.select(F.floor(F.col("vec_id") / length).alias("request_id"), F.floor(F.col("s") / 2).cast("int").alias("layer_idx"),
                       (F.col("s") % 2).cast("int").alias("head"), (F.col("vec_id") % length).cast("int").alias("pos"), part(1).alias("q"), part(9).alias("k"))


def sample_labels(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    return (read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / length).alias("request_id"))
            .agg((F.sum("label") % 2).cast("int").alias("label")))
