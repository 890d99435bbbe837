"""The wide feature table: one row a request, a column for every signal, feature, layer and head that the configuration names, and the sample's metadata.

The columns follow from the configuration, so a feature that no snapshot has is a null column.  What would be lost or wrong is an error of the job that writes the table, in whatever row
it is: a feature without a column, a request without a sample, a sample without its label, id or phase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attnlens.functions.arrays import scrubbed
from attnlens.sources.tokens import KEY

_SPECTRAL = ("sv1", "sv_ratio", "sv_entropy")
#: Scalar features of each signal, and the list that is spread over columns, with their names.
SCALARS = {
    "spectral": _SPECTRAL, "routing": (*_SPECTRAL, "sigma2", "sigma2_asym", "commutator_norm", "phi_hat", "g", "gamma", "c", "curl_ratio"),
    "tracker": (*_SPECTRAL, "sigma2", "sigma2_asym", "commutator_norm"), "selfattn": ("logmean",), "laplacian": (), "asymmetry": ("g", "gamma", "c"),
    "cyclic": ("t_cyc",), "magnetic": ("frustration",)}
LISTS = {"selfattn": ("eigvals", "eigval"), "laplacian": ("eigvals", "eigval")}
NEEDED = ("label", "sample_id", "phase")


def names(signals: list[str], tops: dict[str, int] | None = None) -> list[str]:
    """``{signal}_{feature}`` of the signals, lists up to ``tops`` of each (0: none)."""
    out = []
    for signal in signals:
        if signal not in SCALARS:
            raise ValueError(f"no signal {signal!r}; there are {', '.join(sorted(SCALARS))}")
        out += [f"{signal}_{c}" for c in SCALARS[signal]]
        if signal in LISTS:
            out += [f"{signal}_{LISTS[signal][1]}_{i}" for i in range((tops or {}).get(signal, 0))]
    return out


def columns(signals: list[str], layers: int, heads: list[int], tops: dict[str, int] | None = None) -> list[str]:
    return [f"{n}_L{layer}_H{h}" for n in names(signals, tops) for layer in range(layers) for h in heads]


def _listed(signal: str, top: int) -> Column:
    column, one = LISTS[signal]
    return F.transform(F.slice(column, 1, top), lambda x, i: F.struct(F.concat(F.lit(f"{signal}_{one}_"), i.cast("string")).alias("name"), scrubbed(x.cast("double")).alias("value")))


def long(found: dict[str, DataFrame], tops: dict[str, int] | None = None) -> DataFrame:
    """``name, value`` of every feature of ``found`` (signal: its table); values that are not finite are null."""
    parts = []
    for signal, df in sorted(found.items()):
        values = [F.struct(F.lit(f"{signal}_{c}").alias("name"), scrubbed(F.col(c).cast("double")).alias("value")) for c in SCALARS[signal]]
        rows = F.array(*values) if values else F.array().cast("array<struct<name:string,value:double>>")
        if signal in LISTS and (top := (tops or {}).get(signal, 0)):
            rows = F.concat(rows, _listed(signal, top))
        parts.append(df.select(*KEY, F.explode(rows).alias("f")).select(*KEY, "f.name", "f.value"))
    return reduce(DataFrame.unionByName, parts)


def wide(features: DataFrame, samples: DataFrame, asked: list[str]) -> DataFrame:
    """``request_id``, the columns of ``samples`` and those of ``asked``; ``samples`` has a row for each request.  See above for what is an error."""
    spark, fail = features.sparkSession, lambda *text: F.raise_error(F.concat(*[t if not isinstance(t, str) else F.lit(t) for t in text]))
    known = F.broadcast(spark.createDataFrame([(c,) for c in asked], "known string"))  # as many rows as the table has columns
    name = F.concat("name", F.lit("_L"), F.col("layer_idx").cast("string"), F.lit("_H"), F.col("head").cast("string"))
    rows = features.withColumn("column", name).join(known, F.col("known") == F.col("column"), "left")
    rows = rows.select("request_id", F.when(F.col("known").isNotNull(), F.col("column")).otherwise(fail("no column for ", F.col("column"))).alias("column"), "value")
    # all features of a request meet in one row before they are spread over columns
    maps = rows.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("values"))
    meta = samples.select(F.col("request_id").alias("of"), F.struct(*[c for c in samples.columns if c != "request_id"]).alias("meta"))
    both = maps.join(meta, F.col("of") == F.col("request_id"), "left")
    complete = reduce(lambda a, b: a & b, [F.col(f"meta.{c}").isNotNull() for c in NEEDED])
    checked = (F.when(F.col("of").isNull(), fail("no sample of request ", F.coalesce(F.col("request_id").cast("string"), F.lit("null"))))
               .when(~complete, fail("a sample without label, id or phase: request ", F.col("request_id").cast("string"))).otherwise(F.col("request_id")))
    return both.select(checked.alias("request_id"), "meta.*", *[F.try_element_at("values", F.lit(c)).alias(c) for c in asked])


def write(table: DataFrame, path: str) -> dict[str, int]:
    """Writes the table in one pass and gives its numbers of rows and of rows without any feature."""
    seen = Observation("wide")
    features = [c for c in table.columns if "_L" in c and "_H" in c]
    empty = F.coalesce(*[F.col(c) for c in features]).isNull() if features else F.lit(True)
    table.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty")).write.mode("overwrite").parquet(path)
    return seen.get
