import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import common


@pytest.mark.parametrize("hot", [2_000, 3])
def test_join_counted(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, 5, None]), k) for k in range(80)]
    df = spark.createDataFrame(rows, "g long, k long")
    counts = df.groupBy("g").agg(F.count("*").alias("n")).where("g <> 4").withColumn("name", F.concat(F.lit("g"), F.col("g").cast("string")))
    got = common.join_counted(df, "g", counts, len(rows))
    assert got.columns == ["g", "k", "name"]
    assert sorted((x.g, x.k, x.name) for x in got.collect()) == sorted((g, k, f"g{g}") for g, k in rows if g not in (4, None))
    assert common.join_counted(df.limit(0), "g", counts.limit(0), 0).count() == 0


def test_groups_across_batches():
    r = random.Random(2)
    keys = sorted(r.choices(range(12), k=200))
    table = pa.table({"a": pa.array(keys, pa.int64()), "b": pa.array([k % 3 for k in keys], pa.int64()), "v": pa.array(range(200))})
    for size in (1, 7, 50, 200):
        batches = [b for b in table.to_batches(max_chunksize=size)]
        groups = list(common.grouped(iter(batches), ["a", "b"]))
        assert [set(g.column("a").to_pylist()) for g in groups] == [{k} for k in sorted(set(keys))] and [v for g in groups for v in g.column("v").to_pylist()] == list(range(200))
    assert list(common.grouped(iter([]), ["a"])) == []


def test_local_least():
    assert common.local_least(5, np.array([3, 1]), np.array([1, 4])).tolist() == [0, 1, 2, 1, 1]


def test_scratch_removes_what_is_made_within(spark):
    kept = common.fresh_path(spark, "kept")
    with common.scratch(spark):
        common.materialize(spark.range(3), "gone")
        inner = common._SCOPES[-1][0]
        out = common.materialize(spark.range(5), "kept", path=kept)
    assert out.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)


def test_located_names_rows_of_any_plan(spark, tmp_path):
    spark.range(40).repartition(3).selectExpr("id as doc_id", "'t' as text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = {(r["loc"], r.doc_id) for r in common.located(docs, F.col("doc_id")).collect()}
    assert len(rows) == 40 and rows == {(r["loc"], r.doc_id) for r in common.located(docs.select("text", "doc_id").where("doc_id >= 0"), F.col("doc_id")).collect()}
    twice = docs.select("text", F.explode(F.array(F.lit(1), F.lit(2))).alias("doc_id"))  # not a row of a file each
    assert len({r["loc"] for r in common.located(twice, F.col("doc_id")).collect()}) == 80
    assert len({r["loc"] for r in common.located(docs.unionAll(docs), F.col("doc_id")).collect()}) == 80
