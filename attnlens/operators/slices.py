"""Count windows over rows that are slices of several tokens: only whole slices enter and leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding(rows: DataFrame, key: str, order: list[str], span: str, most: int) -> DataFrame:
    """``rows`` with ``first`` (number from 1 of the oldest slice held after this one came; null if none), ``n_slices`` and ``n_tokens``.

    The oldest slices go until at most ``most`` tokens are left (0: none goes), so a slice of more than ``most`` tokens empties the window, itself included.  What stays is the longest
    run of slices up to this one with at most ``most`` tokens, so it follows from running sums: the least sum not below this one's less ``most``.  ``span`` is 1 or more."""
    w = Window.partitionBy(key).orderBy(*order)
    run = rows.withColumns({"_sum": F.sum(F.col(span).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(w).cast("long")})
    if most <= 0:
        return run.select(*rows.columns, F.lit(1).cast("long").alias("first"), F.col("_at").alias("n_slices"), F.col("_sum").alias("n_tokens"))
    near = Window.partitionBy(key).orderBy("_sum").rangeBetween(-most, 0)
    # the slice before the window: none if all sums so far are within reach
    before = F.when(F.col("_sum") > most, F.min(F.struct("_sum", "_at")).over(near))
    held = run.withColumn("_before", before)
    at, total = F.coalesce("_before._at", F.lit(0)), F.coalesce("_before._sum", F.lit(0))
    return held.select(*rows.columns, F.when(F.col("_at") > at, at + 1).alias("first"), (F.col("_at") - at).alias("n_slices"), (F.col("_sum") - total).alias("n_tokens"))


def tumbling(rows: DataFrame, key: str, order: list[str], span: str, least: int) -> DataFrame:
    """``key, window_id, n_slices, n_tokens``: disjoint windows, each ended by the slice that brings it to ``least`` tokens; what is left at the end never fires.

    Where a window begins depends on all before, so a key's slices pass one task in order; it holds three numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window, n, total = object(), 0, 0, 0
        for batch in batches:
            at, out = [], ([], [], [])
            for i, (k, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k != now:
                    now, window, n, total = k, 0, 0, 0
                n, total = n + 1, total + size
                if total >= least:
                    at.append(i)
                    for column, value in zip(out, (window, n, total), strict=True):
                        column.append(value)
                    window, n, total = window + 1, 0, 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], [key, "window_id", "n_slices", "n_tokens"])

    if least <= 0:
        raise ValueError("a tumbling window needs a size")
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, span, *order).repartition(key).sortWithinPartitions(key, *order).select(key, span).mapInArrow(run, f"{key} {kind}, window_id bigint, n_slices bigint, n_tokens bigint")
