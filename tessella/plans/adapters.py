"""The given tables seen as the engine's inputs: samples, objects, polygons, rasters, boxes, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import point
from tessella.operators.dataset import split_assign, with_labels

TRAIN, VAL, SEED = 70, 20, 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows as label files: class 0 for quality, class 1 for toxic; a row may hold neither."""
    each = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), each.alias("classes"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(split_assign(images(spark, sf_dir), TRAIN, VAL, SEED), classes(spark, sf_dir), ["sample_id"])


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rings in the unit square: two components a point."""
    e = F.col("embedding")
    unit = lambda i: (F.element_at(e, i).cast("double") + 1) / 2
    ring = F.transform(F.sequence(F.lit(0), (F.size(e) / 2 - 1).cast("int")), lambda i: point(unit(2 * i + 1), unit(2 * i + 2)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class_id"), ring.alias("points"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 64).alias("cols"), ((51 - F.col("p_size")) * 64).alias("rows"))
    return p.select("raster_id", "cols", "rows", F.lit(1.0).alias("cell_x"), F.lit(1.0).alias("cell_y"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.col("cols").cast("double").alias("xmax"), F.col("rows").cast("double").alias("ymax"), F.lit(0).alias("srid"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on their part's raster; they may reach beyond it. det_id is made of the keys
    and a number within equal ones, so it is the same in every evaluation."""
    r = rasters(spark, sf_dir).select("raster_id", "cols", "rows")
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_discount", "l_returnflag")
    items = read(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(same))
    j = items.join(r, F.col("l_partkey") == F.col("raster_id"))
    x = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % F.col("cols")).cast("double")
    y = ((F.col("l_orderkey") * 53 + F.col("l_linenumber") * 211) % F.col("rows")).cast("double")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    det_id = F.col("l_orderkey").cast("long") * 10_000 + F.col("l_linenumber") * 1_000 + F.col("rn")
    return j.select("raster_id", det_id.alias("det_id"), kind.alias("class_id"), (F.lit(0.5) + F.col("l_discount") * 5).alias("confidence"), x.alias("xmin"), y.alias("ymin"), (x + F.col("l_quantity")).alias("xmax"), (y + F.col("l_quantity")).alias("ymax"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as annotation shapes of one ring."""
    b = boxes(spark, sf_dir)
    ring = F.array(point(F.col("xmin"), F.col("ymin")), point(F.col("xmax"), F.col("ymin")), point(F.col("xmax"), F.col("ymax")), point(F.col("xmin"), F.col("ymax")))
    return b.select("raster_id", F.col("det_id").alias("shape_no"), "class_id", F.array(ring).alias("rings"))


def grid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("name"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as label lines of five kinds: boxes, triangles, a lone class, a bad number, five
    values, by line number."""
    i = read(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    q, d, t = (s(F.col("l_quantity") / 64), s(F.col("l_discount")), s(F.col("l_tax")))
    c = s(F.col("l_orderkey") % 9 + F.lit(0.6))
    line = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat_ws(" ", c, q, d, t, q))
        .when(F.col("l_linenumber") % 5 == 1, F.concat_ws("  ", c, q, d, t, q, d, d))
        .when(F.col("l_linenumber") % 5 == 2, c)
        .when(F.col("l_linenumber") % 5 == 3, F.concat_ws(" ", F.lit("x"), q, d, t, q))
        .otherwise(F.concat_ws(" ", c, q, d, t, q, d))
    )
    return i.select("l_orderkey", "l_linenumber", line.alias("line"))
