"""The registered queries over a whole small table: against SQL, and against the libraries and plain rules."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import queries as q
from tessella.llm.pii import luhn

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = q.QUERIES[name](spark, SF), con.sql(q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    places = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in places) for r in want.fetchall())


def test_op1(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = q.op1_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_op3_and_op7(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    rows = q.op3_packing(spark, SF).collect()
    covered = {i: 0 for i in texts}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = [*ids[r.doc_id], 0]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(own) and r.length <= 1024 and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) + 1 for i, x in ids.items()} and len({r.sequence_id for r in rows}) == len(rows)
    counts = q.op7_token_counts(spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts} == {(i, len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts.items()} and len(counts) == len(texts)


def joined(text, rules, ok):
    kinds = list(rules)
    found = [(m.start(), kinds.index(k), m.end()) for k, rule in rules.items() for m in re.finditer(rule, text) if ok(k, m)]
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def test_op2_and_op5(spark, texts):
    pii = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    secret = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}

    def personal(kind, m):
        digits = re.sub("[^0-9]", "", m[0])
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    kept = lambda kind, m: len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16)
    for rows, rules, ok in ((q.op2_personal_data(spark, SF).collect(), pii, personal), (q.op5_secrets(spark, SF).collect(), secret, kept)):
        assert len(rows) == len(texts) and all(r.base_sha256 == joined(texts[r.doc_id], rules, ok) for r in rows)


def test_op6(spark, texts):
    for r in q.op6_audio_features(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature and r.n_tensors >= 1 and len(r.tensors_sha256) == 64 and all(s.start_s < s.end_s for s in r.spans)


def test_op8(spark, texts):
    rows = q.op8_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
