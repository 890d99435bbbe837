"""Cross-site line dedup by distinct-site spread.

A line's spread is the number of distinct sites (sources) it is found on.  One aggregation per line
hash merges a HyperLogLog sketch of the sites and keeps the line's first place.  Lines whose
estimate lies near the threshold are counted exactly; lines at or above it are boilerplate.
Every occurrence of a boilerplate line goes, except its first (smallest doc_id, then place), so
no content is lost from the corpus.

All of it is DataFrame work.  Sketches combine before the shuffle, so a line in a third of all
documents is one partial row per task; the join that marks occurrences carries hashes only, and
AQE splits its hot keys.

Defined cases: lines of fewer than ``min_words`` words are never boilerplate; white space around
a line does not matter, other differences do; a null site is no site; a null text has no lines and
stays null; an empty text is one empty line; repeated rows get equal results; an empty table gives
no rows; extra columns are kept by ``drop_boilerplate`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the sketch's registers: a relative error of 1.04 / sqrt(2 ** 10) = 3.3 %.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(text: Column) -> Column:
    """What tells two documents of one doc_id apart; equal rows share it."""
    return F.xxhash64(text)


def line_places(docs: DataFrame, min_words: int, doc_id: str = "doc_id", text: str = "text",
                site: str = "source") -> DataFrame:
    """``doc_id, doc_key, site, pos, line_hash`` for every line that can be boilerplate."""
    trimmed = F.trim(F.col("line"))
    return (docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("doc_key"), F.col(site).alias("site"),
                        F.posexplode(_lines(F.col(text))).alias("pos", "line"))
            .where(F.size(F.split(trimmed, r"\s+")) >= min_words)
            .select("doc_id", "doc_key", "site", "pos", F.xxhash64(trimmed).alias("line_hash")))


def boilerplate(places: DataFrame, min_sites: int) -> DataFrame:
    """``line_hash, first_doc, first_pos, spread`` of the lines on at least ``min_sites`` sites."""
    spread = places.groupBy("line_hash").agg(
        F.hll_sketch_agg(F.col("site"), F.lit(LG_K)).alias("sketch"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.min("site").alias("low"), F.max("site").alias("high"))
    # one site only: no sketch is needed to see that
    spread = (spread.where(F.col("low") != F.col("high"))
              .select("line_hash", "first", F.hll_sketch_estimate("sketch").alias("estimate")))
    margin = 4 * ERROR
    low, high = min_sites * (1 - margin) - 0.5, min_sites * (1 + margin) + 0.5
    near = spread.where(F.col("estimate").between(low, high)).select("line_hash")
    exact = (places.select("line_hash", "site").join(near, "line_hash", "left_semi")
             .groupBy("line_hash", "site").agg(F.count(F.lit(1)).alias("n")).where(F.col("site").isNotNull())
             .groupBy("line_hash").agg(F.count(F.lit(1)).alias("exact")))
    return (spread.where(F.col("estimate") >= low).join(exact, "line_hash", "left")
            .withColumn("spread", F.coalesce(F.col("exact"), F.col("estimate")))
            .where(F.col("spread") >= min_sites)
            .select("line_hash", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"), "spread"))


def removals(docs: DataFrame, min_sites: int = 3, min_words: int = 3, doc_id: str = "doc_id", text: str = "text",
             site: str = "source") -> DataFrame:
    """``doc_id, doc_key, removed`` (positions of the lines that go) of the documents that lose any."""
    places = line_places(docs, min_words, doc_id, text, site)
    marked = places.join(boilerplate(places, min_sites), "line_hash").where(
        ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    return marked.groupBy("doc_id", "doc_key").agg(F.collect_set("pos").alias("removed"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 3, min_words: int = 3, doc_id: str = "doc_id",
                     text: str = "text", site: str = "source") -> DataFrame:
    """``row`` (the whole input row), ``n_lines``, ``n_removed`` and the remaining ``text``."""
    gone = removals(docs, min_sites, min_words, doc_id, text, site)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), _key(F.col(text)).alias("_key"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("doc_key")), "left")
    body = F.col("row").getField(text)
    removed = F.col("removed")
    kept = F.filter(_lines(body), lambda _, i: ~F.array_contains(removed, i))
    return joined.select(
        "row", F.when(body.isNull(), 0).otherwise(F.size(_lines(body))).cast("long").alias("n_lines"),
        F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
        F.when(removed.isNull(), body).otherwise(F.array_join(kept, "\n")).alias("text"))
