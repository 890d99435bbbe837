"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
Stage by stage: toxic documents go; boilerplate lines go except at their first place, and with them documents that had lines and
keep none; of each near-duplicate component (five-word shingles, 0.8) the smallest doc_id stays; contaminated documents go;
the rest is packed.  Every stage keeps all other rows and columns as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnlens.llm import decontam, linededup, minhash, packing, toxicity
from attnlens.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < toxicity.CUT).select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    text = F.col("text")
    return out.select(*[text if c == "text" else
                        F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}")).alias(c)
                        if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.with_verdict(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate_lines), ("MinHash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

#: The toxicity model, the tokenizer and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
