"""Labelled samples: pairs, expansions, unions and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "prompt", "response")


def expanded_answers(rows: DataFrame, right: str, wrong: str) -> DataFrame:
    """Two rows of each: the right answer with label 0, the wrong one with label 1; empty answers go."""
    both = F.array(F.struct(F.col(right).alias("response"), F.lit(0).alias("label")), F.struct(F.col(wrong).alias("response"), F.lit(1).alias("label")))
    out = rows.withColumn("x", F.explode(both)).select(*[c for c in rows.columns if c not in (right, wrong)], "x.*")
    return out.where("trim(response) != '' and response != 'nan'")


def answers_with_best(rows: DataFrame, best: str, answers: str) -> DataFrame:
    """One row per answer with its ordinal; the best one comes first if the list lacks it."""
    whole = F.when(F.array_contains(answers, F.col(best)), F.col(answers)).otherwise(F.concat(F.array(best), answers))
    return rows.select(*[c for c in rows.columns if c not in (best, answers)], F.posexplode(whole).alias("ordinal", "response"))


def any_false(flags: str):
    """1 if any flag is false; 0 for none."""
    return F.coalesce(F.exists(flags, lambda x: ~x), F.lit(False)).cast("int")


def united(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources, each with its name as ``failure_mode``."""
    return reduce(DataFrame.unionByName, (df.withColumn("failure_mode", F.lit(n)) for n, df in sorted(sources.items())))


def first_of_each(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each source, in order, numbered from 0.

    The limit is on the row number itself, so Spark keeps ``n`` rows of a source in each task before it shuffles."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("row_index", at).where(F.col("row_index") <= n).withColumn("row_index", F.col("row_index") - 1)


def two_phases(rows: DataFrame) -> DataFrame:
    """A request with the question alone and one with the answer too."""
    return rows.select("*", F.explode(F.array(F.lit("question"), F.lit("full"))).alias("phase")).select(
        "*", F.when(F.col("phase") == "question", F.col("prompt")).otherwise(F.concat_ws("\n", "prompt", "response")).alias("request"))
