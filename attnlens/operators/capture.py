"""From captured slices and paged keys to token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnlens.sources.tokens import KEY


def gather_keys(blocks: DataFrame, tables: DataFrame, block_size: int) -> DataFrame:
    """Keys of each request in token order, through its block table and cut at ``seq_len``.

    ``blocks``: block_id, layer_idx, head, offset, k.  ``tables``: request_id, blocks (in logical order), seq_len.
    """
    used = F.slice("blocks", 1, F.ceil(F.col("seq_len") / block_size).cast("int"))
    refs = tables.select("request_id", "seq_len", F.posexplode(used).alias("ordinal", "block_id"))
    return (refs.join(blocks, "block_id").withColumn("pos", (F.col("ordinal") * block_size + F.col("offset")).cast("int"))
            .where("pos < seq_len").select(*KEY, "pos", "k"))


def with_shared_keys(tok: DataFrame, queries_per_key: int) -> DataFrame:
    """Query heads with the key head they share."""
    q = tok.select(*KEY, "pos", "q").withColumn("kv_head", F.floor(F.col("head") / queries_per_key).cast("int"))
    k = tok.select("request_id", "layer_idx", F.col("head").alias("kv_head"), "pos", "k")
    return q.join(k, ["request_id", "layer_idx", "kv_head", "pos"])


def layer_index(name: Column) -> Column:
    """The layer number in a module name; null without one."""
    return F.nullif(F.regexp_extract(name, r"(?:layers|\.h)\.(\d+)", 1), F.lit("")).cast("int")


def request_numbers(slices: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """``request_no`` (from 0; -1 before the first) and ``step`` in it and its layer.  A slice of several tokens on layer 0 begins a request."""
    w = Window.partitionBy(stream).orderBy(*order)
    begins = F.sum(F.when((F.col("layer_idx") == 0) & (F.col("q_span") > 1), 1).otherwise(0)).over(w) - 1
    step = F.row_number().over(Window.partitionBy(stream, "request_no", "layer_idx").orderBy(*order))
    return slices.withColumn("request_no", begins).withColumn("step", step)


def due_signals(steps: DataFrame, intervals: dict[str, int]) -> DataFrame:
    """One row per step and signal whose interval divides it; the first token alone fires nothing."""
    due = F.array_compact(F.array(*[F.when(F.col("step") % n == 0, F.lit(s)) for s, n in sorted(intervals.items())]))
    return steps.where("step >= 2").withColumn("signal", F.explode(due))
