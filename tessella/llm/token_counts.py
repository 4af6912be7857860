"""Token counts through a digest cache (operator 7).

The cache is a Parquet table (content_digest, tokenizer_digest, n_bytes, n_tokens). A run looks the
digests of its texts up in it, encodes one row of each digest that is missing, appends those, and
joins every document to its count. The tokenizer digest covers every file that counts come from.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each keep their
own row; an empty table gives an empty result; other columns are ignored. A cache that holds a
digest twice (two jobs appended at once) is read as one entry.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import byte_bpe, tokenizer_digest
from tessella.llm.common import arrow_pass, fresh_path, located, shuffles_freed

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_bytes long, n_tokens long"


def _encode_misses():
    bpe = byte_bpe()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [bpe.count(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("content_digest"), batch.column("n_bytes"), pa.array(found, pa.int64())], names=["content_digest", "n_bytes", "n_tokens"])

    return work


def read_cache(spark, path: str, version: str) -> DataFrame:
    """The cache's entries. They are unique unless two jobs appended at once; only then is there an
    aggregate, as without it adaptive execution can split a join's hot digests."""
    found = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    if found.groupBy("content_digest").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_counts(docs: DataFrame, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. cache_path: a folder all executors
    share; without one a new cache serves this call only."""
    spark = docs.sparkSession
    version = tokenizer_digest()
    path = cache_path or fresh_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = located(docs, F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("loc", "doc_id", "text", F.unhex(F.sha2("text", 256)).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    # One row stands for each digest. It is picked over digests and places alone, so a text with very
    # many copies is summed before the shuffle; texts are then dealt by place, not by digest.
    picked = keyed.groupBy("content_digest").agg(F.min("loc").alias("loc"))
    if _exists(spark, path):
        picked = picked.join(read_cache(spark, path, version), "content_digest", "left_anti")
    misses = keyed.join(picked.select("loc").hint("shuffle_hash"), "loc", "left_semi").select("content_digest", "n_bytes", "text")
    counted = arrow_pass(misses, _encode_misses, "content_digest binary, n_bytes long, n_tokens long")
    with shuffles_freed(spark):
        counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_bytes", "n_tokens").write.mode("append").parquet(path)
    known = read_cache(spark, path, version)
    return keyed.select("doc_id", "content_digest", "n_bytes").join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
