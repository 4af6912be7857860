import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import jaccard_join as jj


def truth(rows):
    of = jj.Shingler()
    sets = [set(of(t or "").tolist()) for _, t in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                degree[a] += 1
                degree[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((rows[k][0], least[find(k)], degree[k]) for k in range(len(rows))), len(least)


def made(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    passage, rows = r.choices(words, k=12), []
    for i in range(n):
        if rows and r.random() < 0.55:
            own = r.choice(rows)[1].split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
        else:
            own = r.choices(words, k=r.randint(1, 150)) + passage * (r.random() < 0.5)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("bucket,block,levels", [(48, 256, 6), (3, 4, 3)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, bucket, block, levels):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("LEVELS", levels)):
        monkeypatch.setattr(jj, name, value)
    rows = made(3, 160) + [(900, None), (901, ""), (902, "?!"), (903, "one two"), (904, "One two!"), (0, "one two"), (905, "w " * 9000)]
    long = [f"word{k}" for k in range(160)]
    r = random.Random(2)
    rows += [(2000 + k, " ".join(w if j != r.randrange(len(long)) else f"new{k}" for j, w in enumerate(long))) for k in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as rid", "1 as label").coalesce(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = jj.join(docs).collect()
    want, classes = truth(rows)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == want
    kept = jj.apply(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x.first for x in got) == classes


def test_overlaps_and_empty(spark, tmp_path):
    r = np.random.default_rng(1)
    x, y = ([np.unique(r.integers(0, 300, r.integers(1, 90)).astype(np.uint64)) for _ in range(k)] for k in (12, 9))
    assert np.array_equal(jj.overlaps(x, y), [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    empty = spark.read.parquet(str(tmp_path / "e"))
    assert jj.join(empty).count() == 0 and jj.apply(empty).count() == 0


def test_null_ids_and_other_splits_of_the_files(spark, tmp_path):
    rows = [(None, "a b c d e f g"), (3, "A b c d e f g"), (None, "x"), (4, "x"), (4, None), *made(8, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "n"))
    docs = spark.read.parquet(str(tmp_path / "n"))
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append((sorted(map(str, jj.join(docs).select("doc_id", "class_id", "n_links", "first").collect())), sorted(map(str, jj.apply(docs).collect()))))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and "Row(doc_id=3, class_id=None, n_links=1, first=False)" in seen[0][0] and "Row(doc_id=4, class_id=None, n_links=1, first=False)" in seen[0][0]


def test_near_copies_among_frequent_passages(spark, tmp_path):
    """With the constants as they are: each text is 60 of 100 passages, so no shingle tells few texts
    apart and last buckets hold more than BUCKET texts; every tenth swaps 5 of its predecessor's."""
    r = random.Random(5)
    passages, rows, own = [f"p{k} q{k} r{k} t{k} s s s s" for k in range(100)], [], []
    for i in range(3000):
        if i % 10 == 1:
            own = sorted([*r.sample(own, 55), *r.sample([k for k in range(100) if k not in own], 5)])
        else:
            own = sorted(r.sample(range(100), 60))
        rows.append((i, " ".join(passages[k] for k in own)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "p"))
    got = {x.doc_id: (x.class_id, x.n_links) for x in jj.join(spark.read.parquet(str(tmp_path / "p"))).collect()}
    pairs = [(i - 1, i) for i in range(1, 3000, 10)]
    assert all(truth([rows[a], rows[b]])[1] == 1 for a, b in pairs)
    recall = sum(got[b] == (a, 1) for a, b in pairs) / len(pairs)
    assert recall >= 0.97
    assert all(got[i] == (i, 0) for i in range(3000) if i % 10 > 1)


def test_runs_reach_the_target_at_full_depth():
    assert jj.LEVELS >= 6 and jj.recall(jj.RUNS) >= jj.TARGET > jj.recall(jj.RUNS - 1)
    r, n = np.random.default_rng(4), 600
    met = 0
    for _ in range(n):
        a = r.integers(0, 1 << 32, jj.TOKENS, dtype=np.uint32)
        b = np.where(r.random(jj.TOKENS) < jj.THRESHOLD, a, a ^ np.uint32(1))
        paths = jj._ROOTS
        for _ in range(jj.LEVELS):
            x, y = (jj.chosen(paths, np.broadcast_to(e, (len(paths), jj.TOKENS)))[0] for e in (a, b))
            paths = np.intersect1d(x, y)
        met += len(paths) > 0
    assert met / n >= jj.TARGET - 0.02


def test_texts_of_a_passage_alone_are_not_split_further(spark, tmp_path, monkeypatch):
    """A passage of half of each text, in 400 texts, and 60 near copies of one of them, which are linked at once:
    few rows go on from large buckets, and nothing is lost."""
    r = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(60)])) for i in range(400)]
    rows += [(1000 + k, rows[7][1] + f" end{k}") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "q"))
    made, real = [], jj.materialize

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "large":
            made.append(out.count())
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    got = jj.join(spark.read.parquet(str(tmp_path / "q"))).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == truth(rows)[0]
    assert sum(made) < 10 * len(rows)


def test_possible_keeps_every_candidate():
    r = np.random.default_rng(6)
    e = r.integers(0, 1 << 32, (300, jj.TOKENS), dtype=np.uint32)
    e[:, :40] = e[0, :40]  # a passage
    for a, b in ((5, 9), (9, 70), (100, 200)):
        e[b] = np.where(np.arange(jj.TOKENS) % 3 > 0, e[a], e[b])
    near = (e[:, None, :] == e[None, :, :]).mean(2) >= jj.CANDIDATE
    np.fill_diagonal(near, False)
    kept = jj.possible(e)
    assert set(np.flatnonzero(near.any(1)).tolist()) <= set(kept.tolist()) and len(kept) < 20
    assert len(jj.possible(e[:0])) == 0


def test_near_copies_beside_texts_of_their_passage_go_no_further(spark, tmp_path, monkeypatch):
    """Texts that are mostly one passage, the least of them unlike the rest, and a chain of near copies of one that
    a single text is not near to: all are linked in the buckets they meet in first, so no row is made of deeper ones,
    and twice the group makes no more than twice the rows."""
    rows_made, real = [], jj.materialize

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "paths":
            rows_made[-1].append(out.count())
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    for n in (100, 200):
        r = random.Random(11)
        passage = [f"p{k}" for k in range(160)]
        rows = [(i, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(55)])) for i in range(100)]
        own = passage + [f"c{k}" for k in range(60)]
        for i in range(n):
            own = own[:160] + own[160 + (i % 5 == 0) :] + [f"n{i}"] * (i % 5 == 0)
            rows.append((1000 + i, " ".join([*own, f"end{i}"])))
        path = str(tmp_path / f"g{n}")
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
        rows_made.append([])
        got = jj.join(spark.read.parquet(path)).collect()
        assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == truth(rows)[0]
    assert all(sum(made[1:]) == 0 for made in rows_made) and rows_made[1][0] <= 2 * rows_made[0][0]


@pytest.mark.parametrize("few,pivots", [(512, 16), (3, 2), (0, 1)])
def test_gathered_buckets_lose_no_candidate(monkeypatch, few, pivots):
    """Each pair near enough is linked in its bucket, or both go on to the next splits."""
    monkeypatch.setattr(jj, "FEW", few)
    monkeypatch.setattr(jj, "PIVOTS", pivots)
    r = np.random.default_rng(12)
    e = r.integers(0, 1 << 32, (150, jj.TOKENS), dtype=np.uint32)
    e[:, :82] = e[0, :82]  # a passage, too short to make near what shares no more
    for k in range(60, 140):
        e[k] = np.where(r.random(jj.TOKENS) < 0.1, e[k], e[r.integers(k // 10 * 10, k) if k % 10 else k])
    nodes = r.permutation(150) * 7
    batch = pa.record_batch([pa.array([5] * 150, pa.int64()), pa.array(nodes, pa.int64()), pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in e], pa.binary())], names=["path", "node", "root", "sketch"])
    out = pa.Table.from_batches(list(jj._gathered(iter([batch])))).to_pylist()
    root, goes = {int(x): int(x) for x in nodes} | {x["node"]: x["root"] for x in out}, {x["node"] for x in out if x["open"]}
    near = (e[:, None, :] == e[None, :, :]).mean(2) >= jj.CANDIDATE
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        assert root[nodes[i]] == root[nodes[j]] or {nodes[i], nodes[j]} <= goes
    assert (few == 512) == (not goes) and all(not x["paths"] for x in out if not x["open"])
    assert all(len(x["paths"]) == len(jj.chosen(np.array([5], np.uint64), e[list(nodes).index(x["node"])][None])[0]) for x in out if x["open"])
    close = {x["root"] for x in out if x["open"] and x["near"]}
    assert len(close) <= 1


def test_buckets_that_no_task_holds(spark, tmp_path, monkeypatch):
    """Buckets over GATHERED are compared with their least node and split whole, also into held ones."""
    monkeypatch.setattr(jj, "GATHERED", 70)
    r = random.Random(13)
    passage = [f"p{k}" for k in range(160)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(55)])) for i in range(60)]
    rows += [(100 + k, rows[7 + k % 2][1] + f" end{k}") for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "b"))
    got = jj.join(spark.read.parquet(str(tmp_path / "b"))).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == truth(rows)[0]
