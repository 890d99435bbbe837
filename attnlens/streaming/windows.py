"""Count windows over a stream, with the open window of each key in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, key: str, order: list[str], width: int, value: str = "value") -> DataFrame:
    """``key, window_id, n, total`` of every full window of ``width`` rows of a key.

    Rows count in ``order`` inside a micro-batch, and batches in the order of their arrival.  State: rows, sum and number of the open
    window, of the same size for every key.  Null values count as rows and add nothing.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, window = state.get if state.exists else (0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        values = rows[value].fillna(0.0).to_numpy()
        out, at = [], 0
        while at < len(values):
            take = min(width - n, len(values) - at)
            n, total, at = n + take, total + float(values[at : at + take].sum()), at + take
            if n == width:
                out.append((k[0], window, n, total))
                n, total, window = 0, 0.0, window + 1
        state.update((n, total, window))
        yield pd.DataFrame(out, columns=[key, "window_id", "n", "total"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value, *order).groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, window_id bigint, n bigint, total double", "n bigint, total double, window bigint", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs ``stream`` over what its source holds now into a Parquet table under ``folder`` and reads that."""
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
