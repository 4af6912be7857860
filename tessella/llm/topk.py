"""Exact top-k inner products over norm-sorted vectors (operator 10).

Vectors become integers, are turned into the basis of the singular vectors of the whole table (its
Gram matrix is summed over partitions) and are stored once by descending length. Queries are a table
dealt into blocks of about QUERY_BLOCK rows; each block passes over the stored vectors on its own and
its result is appended to the table of results, so the driver holds one block at a time and no plan
grows with the queries. Within a task:

- rows come by descending length, so once |q| |x| falls below a query's k-th best score, nothing
  later can enter its result (Cauchy-Schwarz);
- the first coordinates in the turned basis give a partial sum; with the lengths of what is left of
  both vectors it bounds the score, and only rows whose bound reaches the k-th best are scored in
  integers.

The k-th best score starts from the longest vectors, which are few and broadcast with the block.
Turned coordinates are floats, so bounds carry a margin above their rounding error.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part,
as do rows of another length than the most frequent one and rows without an id; ties go to the
smaller id; rows that repeat an id are queries and candidates each, and only a query's own row is no
candidate for it; a query with fewer than k candidates gets all; other columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import arrow_pass, drop_table, fresh_path, materialize

K = 5
#: Queries of a block and longest vectors sent with it: the broadcast is at most their bytes.
QUERY_BLOCK, HEAD = 4_096, 4_096
#: Coordinates of the partial sum, and rows that a task bounds at once.
PART, STEP = 16, 2_048


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component) of the rows that take part."""
    v = F.col("v")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    whole = whole.where(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    sizes = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0].n if sizes else 0
    return whole.where(F.size("v") == dim).select("vec_id", F.transform(v, lambda e: F.floor(e * scale).cast("double")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _gram():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("x"))
        g = (x.T @ x).ravel()
        return pa.record_batch([pa.array(np.arange(len(g))), pa.array(g)], names=["cell", "value"])

    return work


def rotation(x: DataFrame) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value: dim x dim, whatever the
    number of rows."""
    cells = arrow_pass(x.select("x"), _gram, "cell long, value double", rows=8192).groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toArrow()
    g = cells.column("value").to_numpy()
    dim = int(round(len(g) ** 0.5))
    _, vectors = np.linalg.eigh(g.reshape(dim, dim))
    return np.ascontiguousarray(vectors[:, ::-1])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(q_rows: np.ndarray, q: np.ndarray, start: np.ndarray, turn: np.ndarray, k: int):
    """Function for the slices of one task. start: lower bounds of each query's k-th best score."""

    def make():
        qr = q @ turn
        q_len = np.sqrt((q * q).sum(1))
        q_rest = np.sqrt(np.maximum((qr[:, PART:] ** 2).sum(1), 0))
        floor = start.copy()
        best_s = [np.empty(0)] * len(q)
        best_i = [np.empty(0, np.int64)] * len(q)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows, x = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy(), _matrix(batch.column("x"))
            length = np.sqrt((x * x).sum(1))
            out: list[list] = [[], [], []]
            live = np.flatnonzero(q_len * length.max(initial=0) * (1 + 1e-9) + 1e-6 >= floor) if len(x) else np.empty(0, int)
            if len(live):
                xr = x @ turn
                x_rest = np.sqrt(np.maximum((xr[:, PART:] ** 2).sum(1), 0))
                bound = qr[live, :PART] @ xr[:, :PART].T + np.outer(q_rest[live], x_rest)
                bound += 1e-9 * np.outer(q_len[live], length) + 1e-6
                hit_q, hit_x = np.nonzero(bound >= floor[live][:, None])
                scores = np.empty(len(hit_q))
                for at in range(0, len(hit_q), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    scores[part] = np.einsum("ij,ij->i", q[live[hit_q[part]]], x[hit_x[part]])  # integers below 2**53: exact
                cut = np.searchsorted(hit_q, np.arange(len(live) + 1))
                for n, j in enumerate(live.tolist()):
                    own = slice(cut[n], cut[n + 1])
                    if own.start == own.stop:
                        continue
                    s, i = scores[own], ids[hit_x[own]]
                    other = rows[hit_x[own]] != q_rows[j]
                    s, i = np.concatenate([best_s[j], s[other]]), np.concatenate([best_i[j], i[other]])
                    old = len(best_s[j])
                    top = _best(s, i, k)
                    best_s[j], best_i[j] = s[top], i[top]
                    if len(top) == k:
                        floor[j] = max(floor[j], best_s[j][-1])
                    new = top[top >= old]
                    out[0] += [j] * len(new)
                    out[1] += i[new].tolist()
                    out[2] += s[new].tolist()
            return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([int(v) for v in out[2]], pa.int64())], names=["query", "vec_id", "score"])

        return work

    return make


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the limit on the rank is applied before the shuffle as well."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best among
    the other rows. One pass over the stored table for each block of queries."""
    spark = vectors.sparkSession
    x = quantized(vectors, id_col, vec_col)
    length = F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)
    ordered = x.withColumn("length2", length).repartitionByRange(F.desc("length2")).sortWithinPartitions(F.desc("length2"), "vec_id")
    stored = materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "norm-sorted")  # numbered once, in the table
    schema = "query_id long, rank int, vec_id long, score long"
    head = stored.orderBy(F.desc("length2"), "vec_id").limit(HEAD).toArrow()
    if not head.num_rows:
        return spark.createDataFrame([], schema)
    turn = rotation(stored)
    h_rows, h = head.column("row").to_numpy(), _matrix(head.column("x").combine_chunks())
    asked = stored.where(F.col("vec_id") % every == 0).select("row", "vec_id", "x")
    blocks = -(-asked.count() // QUERY_BLOCK)
    queries = materialize(asked.repartition(max(blocks, 1), "row").withColumn("block", F.spark_partition_id()), "queries")
    path = fresh_path(spark, "top-k")
    for block in range(blocks):
        own = queries.where(F.col("block") == block).orderBy("row").toArrow()  # about QUERY_BLOCK rows
        if own.num_rows:
            found = _block(stored, own, h_rows, h, turn, k)
            found.write.mode("append").parquet(path)
    drop_table(stored)
    drop_table(queries)
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def _block(stored: DataFrame, own: pa.Table, h_rows: np.ndarray, h: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """The result of one block of queries (row, vec_id, x)."""
    q_rows, ids, q = own.column("row").to_numpy(), own.column("vec_id").to_numpy(), _matrix(own.column("x").combine_chunks())
    start = np.empty(len(q))
    for at in range(0, len(q), 512):
        s = q[at : at + 512] @ h.T
        s[q_rows[at : at + 512, None] == h_rows[None, :]] = -np.inf
        start[at : at + 512] = np.sort(s, 1)[:, -k] if s.shape[1] >= k else -np.inf
    found = arrow_pass(stored.select("vec_id", "row", "x"), _search(q_rows, q, start, turn, k), "query long, vec_id long, score long", rows=STEP)
    names = F.broadcast(stored.sparkSession.createDataFrame(list(enumerate(ids.tolist())), "query long, query_id long"))
    return _ranked(found, k).join(names, "query").select("query_id", "rank", "vec_id", "score")
