"""Load-test results and GPU-memory samples as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBERS = ("request_rate", "duration", "completed", "request_throughput", "output_throughput", "mean_ttft_ms", "median_ttft_ms", "p99_ttft_ms", "mean_tpot_ms", "median_tpot_ms", "p99_tpot_ms")
_BROKEN = "_broken"


def load_tests(spark: SparkSession, path: str) -> DataFrame:
    """``file, request_rate, ...`` of every result file (one JSON document a file): numbers given as numbers or texts, ``inf`` included, null where absent, and ``broken``:
    the text of a file that is no JSON object."""
    fields = ", ".join(f"{c} string" for c in _NUMBERS)
    rows = (spark.read.schema(f"{fields}, {_BROKEN} string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).json(path)
            .withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
    return rows.select("file", *[F.expr(f"try_cast({c} as double)").alias(c) for c in _NUMBERS], F.col(_BROKEN).alias("broken"))


def best_rates(tests: DataFrame) -> DataFrame:
    """``run`` (the file's name before its last ``-``), ``n`` files that could be read, ``broken`` others, and of the run's file with the largest output the rate and both throughputs."""
    run = F.regexp_replace("file", r"(-[^-]*)?\.json$", "")
    largest = F.max_by(F.struct("request_rate", "request_throughput", "output_throughput"), F.struct(F.col("output_throughput"), -F.col("request_rate")))
    out = tests.withColumn("run", run).groupBy("run").agg(F.count(F.when(F.col("broken").isNull(), 1)).alias("n"), F.count("broken").alias("broken"), largest.alias("best"))
    return out.select("run", "n", "broken", "best.*")


def gpu_memory(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, used_mib`` of memory samples: CSV lines of a time and ``NNN MiB`` (or a bare number), with or without a head; other lines have a null ``used_mib``."""
    rows = spark.read.option("mode", "PERMISSIVE").schema("at string, used string").csv(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    used = F.expr(r"try_cast(regexp_extract(trim(used), '^(\\d+(?:\\.\\d+)?)\\s*(?:MiB)?$', 1) as double)")
    return rows.select("file", F.trim("at").alias("at"), used.alias("used_mib"))


def peak_memory(samples: DataFrame) -> DataFrame:
    """``file, n, peak_mib``: samples that could be read and the largest."""
    return samples.groupBy("file").agg(F.count("used_mib").alias("n"), F.max("used_mib").alias("peak_mib"))
