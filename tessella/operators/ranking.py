"""Reproducible random order: rows by md5 of seed and key, numbered without a one-task window.

The digest's first three digits deal rows to 4,096 even parts; a row's number is its place in its part
plus the sizes of the parts before, so the sort is spread and only the sizes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(seed, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(df: DataFrame, seed, key: str, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with `name`, from 1, within groups in the order of (md5(seed:key), key), and `total`, the
    group's rows. Group columns must not be null."""
    groups = groups or []
    rows = df.withColumn("_h", order_hash(seed, F.col(key))).withColumn("_part", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = sizes.withColumn("_before", F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.withColumn("total", F.sum("_n").over(whole)).select(*groups, "_part", F.coalesce("_before", F.lit(0)).alias("_before"), "total")
    own = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_h", key)))
    return own.join(before, [*groups, "_part"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_h", "_part", "_place", "_before")
