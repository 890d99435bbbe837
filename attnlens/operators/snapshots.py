"""Snapshots: one row per window and signal, their JSON, long and wide feature tables, and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.functions.arrays import scrubbed
from attnlens.sources.tokens import KEY

#: Scalar and list features of each signal.
FEATURES = {"asymmetry": (["g", "gamma", "c"], []), "selfattn": (["logmean"], ["eigvals"]), "laplacian": ([], ["eigvals"]), "cyclic": (["t_cyc"], [])}
#: Names in the long and wide tables begin with these.
PREFIX = {"asymmetry": "hodge_", "selfattn": "ad_", "laplacian": "lap_", "cyclic": "cyc_"}
SCALARS = sorted({c for s, _ in FEATURES.values() for c in s})
FIELDS = ", ".join([f"{c}: double" for c in SCALARS] + ["eigvals: array<double>"])
SCHEMA = f"request_id bigint, layer_idx int, head int, step int, signal string, features struct<{FIELDS}>"


def snapshots(signals: dict[str, DataFrame], step: int) -> DataFrame:
    """The union of signals: every snapshot has all features, null where the signal has none; what is not finite is null."""
    out = None
    for name, df in sorted(signals.items()):
        scalars, lists = FEATURES[name]
        fields = [(scrubbed(F.col(c).cast("double")) if c in scalars else F.lit(None).cast("double")).alias(c) for c in SCALARS]
        fields.append((F.col("eigvals") if lists else F.lit(None).cast("array<double>")).alias("eigvals"))
        part = df.select(*KEY, F.lit(step).alias("step"), F.lit(name).alias("signal"), F.struct(*fields).alias("features"))
        out = part if out is None else out.unionByName(part)
    return out


def write_json(snaps: DataFrame, path: str) -> None:
    """Lines of JSON; nulls are left out."""
    snaps.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_json(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def long_features(snaps: DataFrame, places: int = 0) -> DataFrame:
    """``name, value`` of each snapshot: scalars by their names, lists by their singular and place.  A list of fewer than ``places`` values has null ones behind."""
    prefix = F.coalesce(*[F.when(F.col("signal") == s, F.lit(p)) for s, p in PREFIX.items()])
    scalars = [F.struct(F.lit(c).alias("name"), F.col(f"features.{c}").alias("value")) for c in SCALARS]
    place = lambda i: F.struct(F.concat(F.lit("eigval_"), i.cast("string")).alias("name"), F.get("features.eigvals", i).alias("value"))
    n = F.greatest(F.size("features.eigvals"), F.lit(places))
    lists = F.when(F.col("features.eigvals").isNull() | (n == 0), F.array().cast("array<struct<name: string, value: double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), place))
    rows = snaps.select(*KEY, "step", prefix.alias("prefix"), F.explode(F.concat(F.array(*scalars), lists)).alias("f")).where("f.value is not null" + (" or f.name like 'eigval%'" if places else ""))
    return rows.select(*KEY, "step", F.concat("prefix", "f.name").alias("name"), F.col("f.value").alias("value"))


def wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """One row per request, with a column ``{name}_L{layer}_H{head}`` for each of ``columns``, a list known from the configuration."""
    name = F.concat("name", F.lit("_L"), F.col("layer_idx").cast("string"), F.lit("_H"), F.col("head").cast("string"))
    return long.withColumn("column", name).groupBy("request_id").pivot("column", columns).agg(F.first("value", ignorenulls=True))


def wide_columns(names: list[str], layers: int, heads: int) -> list[str]:
    return [f"{n}_L{layer}_H{h}" for n in names for layer in range(layers) for h in range(heads)]


def spans(snaps: DataFrame) -> DataFrame:
    """Parents per (request, step) and a child per snapshot, whose scalar features are attributes."""
    parent = F.concat_ws("/", F.col("request_id").cast("string"), F.col("step").cast("string"))
    attributes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, SCALARS)), F.array(*[F.col(f"features.{c}") for c in SCALARS])), lambda _, v: v.isNotNull())
    child = F.concat_ws("/", parent, "signal", F.col("layer_idx").cast("string"), F.col("head").cast("string"))
    children = snaps.select(child.alias("span_id"), parent.alias("parent_id"), F.col("signal").alias("name"), F.size(attributes).alias("n_attributes"))
    parents = snaps.select(parent.alias("span_id")).distinct().select("span_id", F.lit(None).cast("string").alias("parent_id"), F.lit("step").alias("name"), F.lit(0).alias("n_attributes"))
    return parents.unionByName(children)
