"""Several handlers of one stream of snapshots, each written once for every batch.

A handler gets the batch's rows and its number.  What it writes goes into a folder of that number and replaces what is there, so a batch that is run again after a failure (of the
handler itself or of one behind it) leaves nothing twice.  Readers take all numbers' folders together.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnlens.operators import snapshots


class Handler(Protocol):
    def handle(self, batch: DataFrame, number: int) -> None: ...

    def read(self, spark: SparkSession) -> DataFrame: ...


def _folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batch={number}"


class JsonLines:
    """Every snapshot as a line of JSON without its nulls."""

    def __init__(self, path: str) -> None:
        self.path = path

    def handle(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", "true").json(_folder(self.path, number))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(snapshots.SCHEMA).option("recursiveFileLookup", "true").json(self.path)


class Spans:
    """Parent and child spans with the scalar features as attributes."""

    def __init__(self, path: str) -> None:
        self.path = path

    def handle(self, batch: DataFrame, number: int) -> None:
        snapshots.spans(batch).write.mode("overwrite").parquet(_folder(self.path, number))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch")


class Lines:
    """A line of text for every snapshot: request, layer, head, step, signal and its scalar features by name."""

    def __init__(self, path: str) -> None:
        self.path = path

    def handle(self, batch: DataFrame, number: int) -> None:
        fields = [F.when(F.col(f"features.{c}").isNotNull(), F.format_string(f"{c}=%.6f", F.col(f"features.{c}"))) for c in snapshots.SCALARS]
        head = F.format_string("request=%d layer=%d head=%d step=%d signal=%s", "request_id", "layer_idx", "head", "step", "signal")
        batch.select(F.concat_ws(" ", head, *fields).alias("value")).write.mode("overwrite").text(_folder(self.path, number))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").text(self.path)


KINDS: dict[str, Callable[[str], Handler]] = {"json": JsonLines, "spans": Spans, "lines": Lines}


def handlers(config: list[dict[str, str]]) -> list[Handler]:
    """Handlers of ``[{"kind": ..., "path": ...}, ...]``; two may not share a path."""
    out = []
    for one in config:
        if one.get("kind") not in KINDS:
            raise ValueError(f"no handler {one.get('kind')!r}; there are {', '.join(sorted(KINDS))}")
        if not one.get("path"):
            raise ValueError(f"handler {one['kind']} needs a path")
        out.append(KINDS[one["kind"]](one["path"]))
    if len({h.path for h in out}) < len(out):
        raise ValueError("two handlers share a path")
    return out


def to_all(sinks: list[Handler]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the batch is made once, every handler gets it, and if any failed the batch fails after the others had theirs."""

    def write(batch: DataFrame, number: int) -> None:
        kept, failed = batch.persist(), []
        try:
            for sink in sinks:
                try:
                    sink.handle(kept, number)
                except Exception as e:  # noqa: BLE001  one handler's failure keeps no other from its rows
                    failed.append(f"{type(sink).__name__}: {e}")
        finally:
            kept.unpersist()
        if failed:
            raise RuntimeError("; ".join(failed))

    return write
