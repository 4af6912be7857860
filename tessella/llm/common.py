"""What the text operators share: reading a column pair, Arrow passes, shared-folder tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Python call works on at a time; it bounds the copies a worker holds.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so other columns never clash; a null text becomes the empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Plans over which a row of the result is a row of a file.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def located(docs: DataFrame, *columns: Column) -> DataFrame:
    """`loc` and the columns, expressions over docs. loc, struct<f: long, r: long>, is a hash of the
    row's file and its place there. It doesn't depend on how files are split, so it names the same
    row in every pass, also after executors came or went. Rows that don't come from Parquet files
    one by one are written to the shared folder first."""
    plan, kinds = docs._jdf.queryExecution().analyzed(), set()
    while True:
        kinds.add(plan.nodeName().split(" ")[0])
        if plan.children().size() != 1:
            break
        plan = plan.children().head()
    if not (plan.children().isEmpty() and kinds <= _ROWWISE and "parquet" in plan.toString().lower()):
        docs = materialize(docs, "rows")
    return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("loc"), *columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's
    checkpoint folder. Only a local master without either gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths made within each open scratch().
_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are made within are removed at the end; results must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution within go at its end, not when the driver happens to collect
    its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and the
    rows outlive any executor. The shuffle files that the write needed go when it ends."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        remove(df.sparkSession, path)


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow in slices. make() runs once per task on the executor and returns the function
    for a slice, so models and automata load there and nothing large is pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Keys with more rows than this (and more than 2 / HOT_KEYS of all rows) are joined by broadcast.
HOT_ROWS, HOT_KEYS = 2_000, 100_000


def join_counted(rows: DataFrame, on: str, table: DataFrame, n_rows: int) -> DataFrame:
    """rows joined (inner) with a table of unique longs. table: `on`, n (the rows of each key) and
    more. A key with very many rows is joined by a broadcast of its one table row, so they stay
    dealt as they are. Such keys have over 2 * n_rows / HOT_KEYS rows each, so there are HOT_KEYS / 2
    of them at most, whatever n_rows is; that many longs reach the driver. n is dropped. The table is
    written first, as it is read for both."""
    bar = max(HOT_ROWS, 2 * n_rows // HOT_KEYS)
    table = materialize(table, "counted")
    hot = [r[0] for r in table.where(F.col("n") > bar).select(on).collect()]
    rest = table.where(F.col("n") <= bar).drop("n")
    if not hot:
        return rows.join(rest, on)
    few = F.broadcast(table.where(F.col("n") > bar).drop("n"))
    return rows.where(F.col(on).isin(hot)).join(few, on).unionByName(rows.where(~F.col(on).isin(hot)).join(rest, on))


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places where a row's keys differ from those of the row before."""
    columns = [batch.column(k).to_numpy() for k in keys]
    return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups out of batches in which the rows of a group follow each other."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.concat_batches(rest)
            rest = []
        cuts = _starts(batch, keys)
        if len(cuts):
            own = [*rest, batch.slice(0, int(cuts[-1]))]
            yield pa.concat_batches(own) if len(own) > 1 else own[0]
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.concat_batches(rest)


def bounds(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """The place of each group in a batch of whole groups, end exclusive."""
    cuts = [0, *_starts(batch, keys).tolist(), batch.num_rows]
    return zip(cuts[:-1], cuts[1:], strict=True)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each group as a batch."""
    for chunk in whole(batches, keys):
        for a, b in bounds(chunk, keys):
            yield chunk.slice(a, b - a)


def local_least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component, for pairs of places."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], int)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y."""
    if len(x) * len(y) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x]).reshape(len(x), len(y))
    _, places, counts = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # a shingle of one set only adds to no intersection
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    use = counts[places] > 1
    rows, columns, width = rows[use], shared[places[use]], int(shared[-1]) + 1 if len(shared) else 0
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, width, 8192):
        m = np.zeros((len(x) + len(y), min(8192, width - at)), np.float32)
        here = (columns >= at) & (columns < at + 8192)
        m[rows[here], columns[here] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out.astype(int)
