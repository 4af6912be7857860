"""The pipeline against stages written plainly over lists."""

import random
import re
import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessella.llm import jaccard_join as jj
from tessella.llm import line_dedup as ld
from tessella.llm import secrets, toxicity
from tests.llm.test_line_dedup import brute_components


def made():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(500)]
    rows = []
    for i in range(150):
        lines = [" ".join(r.choices(words, k=r.randint(6, 25))) for _ in range(r.randint(1, 4))]
        if rows and r.random() < 0.4:
            lines = (r.choice(rows)[1] or "").split("\n")
            own = lines[-1].split(" ")
            own[0] = r.choice(words)
            lines[-1] = " ".join(own)
        if r.random() < 0.2:
            lines[0] += r.choice([" vile grubscum", " grubscum wretchling vile"])
        if r.random() < 0.2:
            lines.append(f"password={''.join(r.choices('0123456789abcdef', k=20))} {r.choice(words)} {i}")
        rows.append((i, "\n".join(lines), "en", "s", 1))
    for i in range(600, 720):
        rows.append((i, " ".join(r.choices(words, k=9)) + " vile grubscum wretchling", "en", "s", 1))
    return rows + [(500, None, None, None, None), (501, "", "en", "s", 0), (3, rows[3][1], "en", "s", 1)]


def test_equals_brute_force(spark, tmp_path):
    rows = made()
    d = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(d / "documents.parquet"))
    labels = [(i, 1, int("grubscum" in (t or ""))) for i, t, *_ in rows if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    docs = spark.read.parquet(str(d / "documents.parquet"))

    model = toxicity.train(docs, spark.read.parquet(str(d / "labels.parquet")))
    score = model.scorer()
    kept = [(r[0], r[1]) for r in rows if score(r[1] or "") < 0.5]
    assert len(kept) < len(rows)

    # Rows of one id and text are alike, so which of them comes first doesn't show.
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0], k))
    lines = {(k, n): x.strip().lower() for k in order for n, x in enumerate((kept[k][1] or "").split("\n")) if x.strip()}
    names = sorted(set(lines.values()))
    label = brute_components(range(len(names)), [(a, b) for a in range(len(names)) for b in range(a) if ld.similarity(names[a], names[b]) >= 0.8])
    seen, at = set(), {x: k for k, x in enumerate(names)}
    after = []
    for k in order:
        own = []
        for n, x in enumerate((kept[k][1] or "").split("\n")):
            c = label[at[lines[k, n]]] if (k, n) in lines else None
            if c is None or c not in seen:
                own.append(x)
            if c is not None:
                seen.add(c)
        after.append((kept[k][0], None if kept[k][1] is None else "\n".join(own)))

    of = jj.Shingler()
    sets = [set(of(t or "").tolist()) for _, t in after]
    label = brute_components(range(len(after)), [(a, b) for a in range(len(after)) for b in range(a) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    after = [row for k, row in enumerate(after) if label[k] == k]

    # Base rules only: the made texts hold no run that the models would add.
    hide = lambda t: re.sub("|".join([rf"(?i:password)=[A-Za-z0-9+/_.=-]{{{secrets.LEAST_ASSIGNED},}}", secrets.HEX]), secrets.MARK, t or "")
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((i, tuple(hf.encode(hide(t), add_special_tokens=False).ids) + (0,)) for i, t in after)

    out = cp.run(spark, str(d)).collect()
    got, by = [], {}
    for r in out:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.doc_id, []).append(r)
    for i, pieces in by.items():
        ids: list[int] = []
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.start)):
            if r.start == 0 and ids:
                got.append((i, tuple(ids)))
                ids = []
            ids += r.ids
        got.append((i, tuple(ids)))
    assert sorted(got) == want


def test_stages_return_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == cp.COLUMNS and out.count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_long_texts_and_clashing_columns(spark, tmp_path):
    """Columns that operators use inside are ignored in documents; long texts and lines stay whole."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(3000)]
    long = " ".join(r.choices(words, k=60_000))
    lines = "\n".join(" ".join(r.choices(words, k=12)) for _ in range(4000))
    rows = [(1, long, "en", "s", len(long)), (2, lines, "en", "s", len(lines)), (3, long + " end", "en", "s", 1), (4, "x " * 50, "en", "s", 100), (None, "lone words here", "en", "s", 1), (5, "", "en", "s", 0), (6, None, None, None, None)]
    clash = ", ".join(f"{k} as {c}" for k, c in enumerate(("loc", "`row`", "score", "predicted", "_kept", "key", "label", "rid", "dropped", "spans", "held_out", "node")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).selectExpr("*", *clash.split(", ")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for x in cp.run(spark, str(tmp_path)).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    n = lambda t: len(hf.encode(t, add_special_tokens=False).ids) + 1
    # 3 holds one line that is like the line of 1, so nothing is left of it, like 5 and 6; each of the empty ones stays.
    assert got == {1: n(long), 2: n(lines), 3: 1, 4: n("x " * 50), None: n("lone words here"), 5: 1, 6: 1}
