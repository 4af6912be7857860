"""Connected components of an edge table by distributed union-find.

Each task runs union-find over its edges and passes on a forest: every node with its least reachable
node there. A node that several tasks saw takes the least of its roots, and the edges between its
other roots and that one make the next, smaller graph. Roots of one level are nodes of the next, so
labels are composed from the last level back. A task holds CHUNK edges at most; a node has at most a
row per task, so none is hot; every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, materialize

CHUNK = 250_000
MAX_LEVELS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        out = pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])
        parent.clear()
        return out

    seen = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
        seen += batch.num_rows
        if seen >= CHUNK:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node that has an edge to another, as a table; label is the least node of
    the component. a, b: columns of longs. Nulls and loops are ignored."""
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "edges")
    levels, tables, own = [], [], Window.partitionBy("node").orderBy("root")
    for _ in range(MAX_LEVELS):
        n = now.count()
        if not n:
            break
        forest = now.coalesce(-(-n // CHUNK)).mapInArrow(_forest, "node long, root long")
        least = materialize(forest.withColumn("place", F.row_number().over(own)).withColumn("m", F.min("root").over(own)), "forest")
        tables.append(least)
        levels.append(least.where("place = 1").select("node", "m"))
        drop_table(now)
        now = materialize(least.where("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b")), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not levels:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = levels[-1].select("node", F.col("m").alias("label"))
    for level in reversed(levels[:-1]):
        out = level.join(out.withColumnRenamed("node", "m"), "m", "left").select("node", F.coalesce("label", "m").alias("label"))
    out = materialize(out, "labels")
    for done in tables:
        drop_table(done)
    return out
