"""Helpers that several training-data operators share.

Word rules
    ``ALNUM_WORD``  lower-cased A-Z, runs of ASCII digits, ASCII letters and any non-ASCII character
    ``SPACE_WORD``  lower-cased A-Z, runs of anything but the six ASCII white-space characters
On UTF-8 bytes both are a byte translation followed by ``split``: non-ASCII characters only
have bytes of 0x80 and above, which neither rule treats as a separator.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ALNUM_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_ALNUM = bytes.maketrans(_UPPER + _ALNUM_DROP, _LOWER + b" " * len(_ALNUM_DROP))
#: bytes.split() splits at space and 0x09-0x0D only, as SPACE_WORD asks.
_SPACE = bytes.maketrans(_UPPER, _LOWER)

ALNUM_WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD_RE = r"[^\x20\x09-\x0D]+"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ``ALNUM_WORD``; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words of ``SPACE_WORD``; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_SPACE).split()


def sliced(column: pa.Array, rows: int = 256) -> Iterator[Any]:
    """The values of an Arrow column, a few as Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def give_back() -> None:
    """Hands memory that earlier tasks left unused in a reused Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose memory goes back to the system when a task ends: idle Python workers count beside the JVM in the steps that follow."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own on a single machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised once in the shared folder, so that a lost executor loses none of it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


#: A key is hot if it has more than 1 / HOT_KEYS of the rows; fewer than HOT_KEYS keys can be.
HOT_KEYS = 1000


def split_join(rows: DataFrame, keyed: DataFrame, key: str, members: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``: one row a key, with the number of ``rows`` that have it (at least) in ``members``; ``total`` is the number of ``rows``.

    Hot keys are broadcast, fewer than HOT_KEYS rows whatever the size, so a key in a third of all rows stays spread over the
    tasks; all other keys meet by a shuffle."""
    limit = total // HOT_KEYS
    hot, cold = keyed.where(F.col(members) > limit), keyed.where(F.col(members) <= limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))
