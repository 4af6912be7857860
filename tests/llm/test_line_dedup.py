import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import line_dedup as ld
from tessella.llm.common import located
from tessella.llm.components import components


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_brute_force(spark, monkeypatch):
    from tessella.llm import components as module

    monkeypatch.setattr(module, "CHUNK", 40)
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def made(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    docs, pool = [], []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            if pool and r.random() < 0.5:
                own = r.choice(pool).split(" ")
                if r.random() < 0.6:
                    own[r.randrange(len(own))] = r.choice(words)
                lines.append(" ".join(own))
            else:
                lines.append(" ".join(r.choices(words, k=r.randint(3, 30))))
                pool.append(lines[-1])
        docs.append((i, "\n".join(lines + ["", "Shared Line of all"][: r.randint(0, 2)])))
    return docs


def wanted(found, text):
    """The places that go by comparing all distinct lines with each other, by loc."""
    places = sorted(((r.doc_id is not None, r.doc_id or 0), r.loc, k, x.strip().lower()) for r in found for k, x in enumerate((text[r.loc] or "").split("\n")) if x.strip())
    distinct = sorted({p[3] for p in places})
    edges = [(i, j) for i in range(len(distinct)) for j in range(i) if ld.similarity(distinct[i], distinct[j]) >= 0.8]
    label = brute_components(range(len(distinct)), edges)
    index, kept, gone = {x: k for k, x in enumerate(distinct)}, set(), {}
    for _, loc, k, x in places:
        if label[index[x]] in kept:
            gone.setdefault(loc, []).append(k)
        kept.add(label[index[x]])
    return gone, edges


def texts_by_loc(docs):
    return {r["loc"]: r.text for r in located(docs, F.col("text")).collect()}


@pytest.mark.parametrize("block,hot", [(256, 64), (3, 2)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block, hot):
    monkeypatch.setattr(ld, "BLOCK", block)
    monkeypatch.setattr(ld, "HOT", hot)
    rows = made(5, 120) + [(500, None), (501, ""), (502, "ab"), (503, "AB \n\nab"), (3, "ab"), (504, "same " * 9), (504, "same " * 9), (None, "same " * 9)]
    # Lines unlike the least of their bucket, which are alike among each other.
    r = random.Random(9)
    base = "".join(r.choices("abcdefghijklmnop ", k=300))
    rows += [(600 + k, base[: 3 * k] + "".join(r.choices("qrstuvw", k=9)) + base[3 * k + 9 :]) for k in range(0, 90, 2)]
    rows += [(800 + k, base[: 150 + k] + "".join(random.Random(k // 2).choices("xyz01234", k=30)) + base[180 + k :]) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).selectExpr("doc_id", "text", "1 as rid", "'x' as dropped", "2 as line_no", "3 as loc", "4 as `row`").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = ld.dedup(docs).collect()
    order, text = {r["loc"]: r for r in found}, texts_by_loc(docs)
    gone, edges = wanted(found, text)
    assert len(edges) > 30 and {r: sorted(v) for r, v in gone.items()} == {r: list(x.dropped) for r, x in order.items() if x.dropped}
    out = ld.apply(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    want = sorted(((d.doc_id, None if text[r] is None else "\n".join(x for k, x in enumerate(text[r].split("\n")) if k not in gone.get(r, ()))) for r, d in order.items()), key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want


def test_recall_in_large_buckets(spark, tmp_path):
    """Hundreds of variants of a line whose pairs lie on both sides of the threshold: of the pairs
    that brute force links, at least 0.99 are in one component."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(3, 8))) for _ in range(500)]
    base, rows = r.choices(words, k=40), []
    for k in range(400):
        own = list(base)
        for _ in range(r.randint(1, 3)):
            own[r.randrange(40)] = r.choice(words)
        rows.append((k, " ".join(own)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "v"))
    lines = ld._lines(located(spark.read.parquet(str(tmp_path / "v")), F.col("doc_id"), F.col("text")))
    number = {x.key: x.doc_id for x in lines.select("key", "doc_id").collect()}
    label = {number[x.node]: number[x.label] for x in ld.classes(lines)[0].collect()}
    edges = [(i, j) for i in range(400) for j in range(i) if ld.similarity(rows[i][1], rows[j][1]) >= 0.8]
    met = sum(i in label and label[i] == label.get(j) for i, j in edges)
    assert len(edges) > 300 and met >= 0.99 * len(edges)
    real = brute_components(range(400), edges)
    assert all(real[i] == real[label[i]] for i in label)


def test_rows_keep_their_names_when_files_are_split_otherwise(spark, tmp_path):
    spark.createDataFrame(made(6, 300), "doc_id long, text string").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "s"))
    docs = spark.read.parquet(str(tmp_path / "s"))
    seen = []
    for size, width in (("128m", "4"), ("2k", "4"), ("8k", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", width)
        seen.append(({(r["loc"], r.doc_id) for r in located(docs, F.col("doc_id")).collect()}, sorted((r.doc_id, tuple(r.dropped)) for r in ld.dedup(docs).collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert len(seen[0][0]) == 300 and seen[0] == seen[1] == seen[2]
    made_here = spark.range(5).selectExpr("id as doc_id", "'x' as text")
    assert len({r["loc"] for r in located(made_here, F.col("doc_id")).collect()}) == 5


def test_runs_cover_all(monkeypatch):
    monkeypatch.setattr(ld, "HELD", 10)
    r = random.Random(1)
    for n in (1, 2, 50):
        sizes = [r.randint(0, 14) for _ in range(n)]
        runs = list(ld._runs(sizes))
        assert [k for a, b in runs for k in range(a, b)] == list(range(n)) and all(b - a == 1 or sum(sizes[a:b]) <= 10 for a, b in runs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    docs = spark.read.parquet(str(tmp_path / "e"))
    assert ld.dedup(docs).count() == 0 and ld.apply(docs).count() == 0


def test_bands_go_in_few_rows(monkeypatch):
    """Lines' bands reach their buckets in packed rows, and the buckets are those of all the bands."""
    monkeypatch.setattr(ld, "PACKED", 3000)
    monkeypatch.setattr(ld, "SLICE", 50)
    r = random.Random(4)
    lines = {k: f"line {r.randrange(10**9)} of {r.randrange(10**9)} words" for k in r.sample(range(-(10**9), 10**9), 300)}
    lines |= {10**10 + k: x + "." * (k % 3) for k, x in enumerate(list(lines.values())[:100])}
    lines |= {10**11 + k: "the same line in many variants " + "x" * (k % 5) for k in range(200)}
    batch = pa.record_batch([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()))], names=["key", "norm"])
    dealt = list(ld._dealt(8)([batch]))
    assert sum(b.num_rows for b in dealt) <= 8 * len(dealt) and len(dealt) <= 1 + len(lines) * ld.BANDS // 2000
    rows = pa.Table.from_batches(dealt).sort_by("part").to_batches()
    got = {(x["band"], x["key"], x["least"]) for b in ld._several(iter(rows)) for x in b.to_pylist()}
    own = {}
    for key, bands in zip(lines, ld.band_hashes(ld.signatures(list(lines.values()))).tolist(), strict=True):
        for band in bands:
            own.setdefault(band, set()).add(key)
    members = {}
    for band, key, least in got:
        members.setdefault(band, set()).update((key, least))
    assert {b: m for b, m in members.items() if len(m) > 1} == {b: m for b, m in own.items() if len(m) > 1}
    assert list(ld._dealt(8)([])) == []
