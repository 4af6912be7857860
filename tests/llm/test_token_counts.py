import public_tokenizers as P
from tokenizers import Tokenizer

from tessella.llm import packing, piece_bpe, token_counts

ROWS = [(1, "the quick brown fox", 0), (2, None, 0), (3, "", 0), (4, "the quick brown fox", 0), (4, "the quick brown fox", 0), (None, "a<|endoftext|>b", 0), (5, "x" * 70_000, 0), (6, "word " * 600, 0)]
SCHEMA = "doc_id long, text string, n_tokens int"


def test_counts_cache_and_cases(spark, tmp_path):
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(i), len((t or "").encode()), n := len(hf.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in ROWS)
    docs, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "cache")
    for kept in (5, 5):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
        assert got == want
        assert spark.read.parquet(path).count() == kept
    spark.read.parquet(path).write.parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")  # as two jobs at once leave it
    assert token_counts.token_counts(docs, path + "2").count() == len(ROWS)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_each_digest_is_encoded_once_and_hits_never(spark, tmp_path, monkeypatch):
    docs, path = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(5), str(tmp_path / "cache")
    token_counts.token_counts(docs, path)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("content_digest").distinct().count() == 5
    spark.createDataFrame([("7", "seven", 0)], "doc_id string, text string, n_tokens int").write.parquet(str(tmp_path / "more"))
    warm = spark.read.parquet(str(tmp_path / "more")).selectExpr("cast(doc_id as long) as doc_id", "text", "n_tokens").unionByName(docs)
    before = {r.content_digest for r in stored.collect()}
    assert token_counts.token_counts(warm, path).count() == len(ROWS) * 3 + 1
    new = [r for r in spark.read.parquet(path).collect() if r.content_digest not in before]
    assert len(new) == 1 and spark.read.parquet(path).count() == 6
    monkeypatch.setattr(token_counts, "tokenizer_digest", lambda: "another")
    token_counts.token_counts(docs, path)
    assert spark.read.parquet(path).where("tokenizer_digest = 'another'").count() == 5


def test_both_paths_of_the_encoder_agree():
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe = token_counts.byte_bpe()
    for n in (4_999, 5_000, 5_001, 49_999, 50_000):
        for text in ("a " + " " * n + "b", "ab" * (n // 2) + "c d", "\n" * n + "x"):
            assert bpe.encode(text).tolist() == hf.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 4] + [(4, "again " * 3000, 0)], SCHEMA)
    repeated = packing.pack(docs.unionAll(docs)).collect()
    rows = packing.pack(docs).collect()
    assert len(repeated) == 2 * len(rows) and len({r.sequence_id for r in repeated}) == len(repeated)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == len(r.ids) for r in rows)
    for i, text, _ in docs.collect():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*hf.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    assert packing.pack(docs.limit(0)).count() == 0


def test_piece_operator_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    encoded = piece_bpe.encode(docs, ("ids", "decoded"))
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and sorted(r.decoded for r in rows) == sorted(t or "" for _, t, _ in ROWS)
    assert sorted(r.decoded for r in piece_bpe.decode(encoded).collect()) == sorted(t or "" for _, t, _ in ROWS)
    assert [list(r.ids) for r in rows if r.decoded == ""] == [[1, 2]] * 2
    assert piece_bpe.encode(docs.limit(0), ("n_tokens", "ids_sha256", "decoded_sha256")).count() == 0


def test_buckets_of_equal_lengths(spark, tmp_path):
    pieces = packing.pack(spark.createDataFrame(ROWS, SCHEMA))
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket <> length or size(ids) <> length").isEmpty() and back.count() == pieces.count()
    lengths = {r.bucket for r in back.select("bucket").distinct().collect()}
    assert len(lengths) > 3 and all(n & (n - 1) == 0 and n <= 1024 for n in lengths)
