"""Cleaning a corpus in stages, each over all rows that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a table; run() writes each result to the shared folder and reads it again
as the next one's docs, so that a lost executor never costs more than one stage. All but the last return the columns of
documents. Rows with null ids or texts and repeated rows are documents like any others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import byte_bpe, decontamination, quality, secrets, similar
from strideline.llm.common import read, saved

#: Ranks for the last stage.
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier gives a probability of good quality below its threshold."""
    model = quality.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    scored = quality.scored(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 resemblance of five-word shingles connect, that with the least id.

    Candidates share Golay keys of SimHash fingerprints; each link is verified exactly.
    """
    return similar.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any ten words in a row of a benchmark item."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars changes by as much as the text, and stays null where it is null."""
    if "n_chars" not in docs.columns:
        return secrets.redacted(docs)
    kind, length = docs.schema["n_chars"].dataType, F.coalesce(F.length("text"), F.lit(0))
    clean = secrets.redacted(docs.withColumn("n_chars", F.col("n_chars").cast("long") - length))
    return clean.withColumn("n_chars", (F.col("n_chars") + length).cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit), and whether decoding them gives the text again."""
    both = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), RANK_FILE), RANK_FILE)
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Neither a trained classifier nor BPE can be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
