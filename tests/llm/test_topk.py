import math
import random

import pytest

from tessella.llm import topk


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if i is not None and v and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for m, (j, x) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,part", [(4096, 16), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "HEAD", 20)
    monkeypatch.setattr(topk, "STEP", 16)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 7) for _ in range(8)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, 0) for i in range(40)]  # many equal ones
    rows += [(20, [9.0] * 8, 0), (20, [9.0] * 8, 0), (20, [-1.0] * 8, 0)]  # an id of several rows
    rows += [(2000, None, 0), (2001, [1.0, None] + [1.0] * 6, 0), (2002, [float("nan")] * 8, 0), (2003, [float("inf")] * 8, 0), (2004, [], 0), (2005, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, 10).collect())
    assert got == brute(rows, 10, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 256 + 512 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0
