"""The three label readers. They accept different lines, so they stay three."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import POINTS, corners, pairs
from tessella.functions.scalars import half_even


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda t: F.length(t) > 0)


def _numbers(line: Column) -> Column:
    return F.transform(tokens(line), lambda t: t.try_cast("double"))


def parse_object(line: Column) -> Column:
    """struct(class_id, points, source_kind) of a line with a class and a box (4 values) or a polygon
    (6 or more, even); null for any other line or a value that is no number. Classes are cut off."""
    n = _numbers(line)
    values = F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0)))
    ok = (F.size(n) >= 5) & ~F.exists(n, lambda v: v.isNull())
    at = lambda i: F.try_element_at(values, F.lit(i))
    box, poly = F.size(values) == 4, (F.size(values) >= 6) & (F.size(values) % 2 == 0)
    points = F.when(box, corners(at(1), at(2), at(3), at(4))).when(poly, pairs(values)).otherwise(F.array().cast(POINTS))
    return F.when(ok & (box | poly), F.struct(F.try_element_at(n, F.lit(1)).try_cast("int").alias("class_id"), points.alias("points"), F.when(box, "bbox").otherwise("poly").alias("source_kind")))


def parse_class(line: Column) -> Column:
    """The class of a line with any token, cut off to an int."""
    return F.try_element_at(_numbers(line), F.lit(1)).try_cast("int")


def parse_report_class(line: Column) -> Column:
    """The class as the report counts it: at least two tokens, rounded half to even, not negative."""
    n = _numbers(line)
    c = half_even(F.try_element_at(n, F.lit(1))).try_cast("int")
    return F.when((F.size(n) >= 2) & (c >= 0), c)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """split, stem, line_no, line of label files <path>/<split>/labels/*.txt; blank lines are null. Files
    without a byte have no row, as Spark passes over them; label_stems() names them too."""
    raw = spark.read.text(f"{path}/*/labels/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    rows = raw.select(F.element_at(F.split("file", "/"), -3).alias("split"), stem(F.col("file")).alias("stem"), F.posexplode_outer(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.when(F.length(F.trim("line")) > 0, F.col("line")))


def label_stems(spark: SparkSession, path: str, split: str) -> DataFrame:
    """stem of each label file of a split, by listing."""
    names = sorted(p.stem for p in Path(path, split, "labels").glob("*.txt"))
    return spark.createDataFrame([(n,) for n in names], "stem string")


def label_classes(lines: DataFrame) -> DataFrame:
    """split, stem, classes: what with_labels() joins."""
    return lines.groupBy("split", "stem").agg(F.collect_list(parse_class(F.col("line"))).alias("classes"))
