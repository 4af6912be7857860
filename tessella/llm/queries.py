"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import audio, jaccard_join, line_dedup, packing, pii, piece_bpe, secrets, token_counts, topk, toxicity
from tessella.llm.common import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(documents(spark, sf_dir), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir), outputs=("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.featurize(documents(spark, sf_dir), outputs=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors", "tensors_sha256", "spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of op2 by kind, which SQL can count."""
    return pii.detect(documents(spark, sf_dir), outputs=("n_email", "n_ip", "n_card", "n_phone"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of op5 by kind, which SQL can count."""
    return secrets.report(secrets.scan(documents(spark, sf_dir))).select("doc_id", "n_assign", "n_access", "n_hex")


def audio_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 stores and reads back, which SQL can digest."""
    return audio.featurize(documents(spark, sf_dir), outputs=("n_bytes", "payload_bytes", "payload_sha256", "media_bytes"))


QUERIES = {"personal_data_counts": personal_data_counts, "secret_counts": secret_counts, "audio_payload": audio_payload, "op1_sentencepiece": op1_sentencepiece, "op2_personal_data": op2_personal_data, "op3_packing": op3_packing, "op4_line_dedup": op4_line_dedup, "op5_secrets": op5_secrets, "op6_audio_features": op6_audio_features, "op7_token_counts": op7_token_counts, "op8_toxicity": op8_toxicity, "op9_jaccard_join": op9_jaccard_join, "op10_topk": op10_topk}
ORACLE_SQL: dict[str, str] = {
    "op10_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (
          SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
          FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
         s AS (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
         d AS (SELECT md5(array_to_string(list_sort(grams), '|')) AS k, min(r) AS node, min(doc_id) AS least, count(*) AS n, any_value(grams) AS grams FROM s WHERE len(grams) > 0 GROUP BY 1),
         g AS (SELECT node, unnest(grams) AS gram FROM d),
         p AS (SELECT a.node AS x, b.node AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node GROUP BY 1, 2),
         e AS (SELECT p.x, p.y FROM p JOIN d a ON a.node = x JOIN d b ON b.node = y WHERE shared * 10 >= 8 * (len(a.grams) + len(b.grams) - shared)),
         reach AS (SELECT node AS x, node AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
         c AS (SELECT reach.x AS node, min(d.least) AS class_id FROM reach JOIN d ON d.node = reach.y GROUP BY 1),
         l AS (SELECT e.x AS node, sum(d.n) AS links FROM e JOIN d ON d.node = e.y GROUP BY 1),
         o AS (SELECT d.k, c.class_id, CAST(coalesce(l.links, 0) + d.n - 1 AS BIGINT) AS n_links FROM d JOIN c USING (node) LEFT JOIN l USING (node))
        SELECT s.doc_id, coalesce(o.class_id, s.doc_id) AS class_id, coalesce(o.n_links, 0) AS n_links FROM s LEFT JOIN o ON o.k = md5(array_to_string(list_sort(s.grams), '|')) AND len(s.grams) > 0""",
    "personal_data_counts": """
        SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text,''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
         CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'), lambda m: list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN len(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INTEGER) END)) <= 255)) AS BIGINT) AS n_ip,
         CAST(len(list_filter(list_transform(regexp_extract_all(coalesce(text,''), '[0-9]([ -]?[0-9])+'), lambda m: regexp_replace(m, '[ -]', '', 'g')), lambda x: len(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 0 THEN CAST(x[i] AS INTEGER) WHEN CAST(x[i] AS INTEGER) > 4 THEN 2 * CAST(x[i] AS INTEGER) - 9 ELSE 2 * CAST(x[i] AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
         CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '[+][0-9][ ().0-9-]+[0-9]'), lambda m: len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM documents""",
    "secret_counts": """
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: len(v) >= 12)) AS BIGINT) AS n_assign,
         CAST(len(list_filter(regexp_extract_all(coalesce(text,''), 'AKIA[A-Z0-9]+'), lambda v: len(v) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '[0-9a-f]+'), lambda v: len(v) >= 16)) AS BIGINT) AS n_hex FROM documents""",
    "audio_payload": """
        WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
        f AS (SELECT doc_id, raw, octet_length(raw) AS n, CASE WHEN octet_length(raw) = 0 THEN 576 ELSE (576 - octet_length(raw) % 576) % 576 END AS fill FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + fill AS BIGINT) AS payload_bytes, sha256(raw || from_hex(repeat('ff', fill))) AS payload_sha256, CAST(n + fill + 44 AS BIGINT) AS media_bytes FROM f""",
}
