"""A corpus pipeline: quality, shared lines, near duplicates, mix of sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.llm import bpe, linededup, minhash, mixing, quality
from canopyspark.llm.common import stage

#: The columns of documents; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the classifier nor the tokens; tests hold each stage against a plain version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more); it learns from the labelled ones among them.

    A null text counts as an empty one, and both get a score; equal rows have equal scores. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.fit(docs, labels)).where(F.col("score") >= quality.CUT).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them share; one that has no words left goes.

    A text that changed gets the number of its code points as n_chars.
    """
    out = linededup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Rows of one doc_id stay together.

    Rows without a doc_id are in no group and all stay. What is joined to the texts are the ids that go, which are few
    and each there once.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: each document as often as it is taken, so one can come twice or not at all.

    Null and empty texts have no words and are never taken; equal rows are taken one by one. An empty table stays empty.
    """
    return mixing.repeat_documents(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of its ids and of the text they decode to.

    Null and empty texts have no ids; repeated rows come as often as they are there. An empty table stays empty.
    """
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids", "decoded")
    return encoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("mix", mix_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
