"""A corpus pipeline of five operators, each stage over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and rereads it for the next stage. A stage's own tables go when it is written,
and its input when the next stage is.

Defined cases: null text is kept as a document unless a stage has a reason to drop it; repeated rows
and ids are documents of their own; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, line_dedup, packing, secrets, toxicity
from tessella.llm.common import documents, drop_table, fresh_path, materialize, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text is now."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels of sf_dir that aren't held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, model, keep=("lang", "source", "n_chars")).where("predicted = 0")
    return kept.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines one stays; documents stay, if with less text."""
    return _sized(line_dedup.apply(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.apply(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; a null text stays null."""
    found = secrets.scan(docs, keep=("lang", "source", "n_chars", F.col("text").isNull().alias("_none")))
    text = F.when(F.col("_kept._none"), F.lit(None).cast("string")).otherwise(secrets.redacted())
    return _sized(found.select("doc_id", text.alias("text"), "_kept.lang", "_kept.source", "_kept.n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: Neither a trained classifier nor a tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, path = docs, fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = materialize(stage(spark, before, sf_dir), name, path=path)
        drop_table(before)
    return docs
