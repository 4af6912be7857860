"""Splits, samples and build totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import half_even
from tessella.operators.ranking import hash_rank


def split_assign(samples: DataFrame, train: int, val: int, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """`split`: shares of a seeded order, rounded half to even, test being the rest."""
    ranked = hash_rank(samples, seed, key, name="rank")
    n_train = F.least(half_even(F.col("total") * train / 100.0), F.col("total"))
    n_val = F.least(half_even(F.col("total") * val / 100.0), F.col("total") - n_train)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "valid").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "total")


def with_labels(images: DataFrame, labels: DataFrame, keys: list[str], required: bool = False) -> DataFrame:
    """Images with their classes. A missing label makes a background, or no sample if required."""
    out = images.join(labels.withColumn("has_label", F.lit(True)), keys, "inner" if required else "left")
    out = out.withColumn("has_label", F.coalesce("has_label", F.lit(False))).withColumn("classes", F.coalesce("classes", F.array().cast("array<int>")))
    return out.withColumn("is_background", F.size("classes") == 0)


def totals(samples: DataFrame) -> DataFrame:
    """Images and labels per split and over all (split null)."""
    return samples.rollup("split").agg(F.count("*").alias("images"), F.sum(F.size("classes")).cast("long").alias("labels"))


def drop_near_empty(images: DataFrame, share: float = 0.985) -> DataFrame:
    """Unlabelled images whose dark and light pixels reach the share go; an unknown share keeps."""
    return images.where(~(F.col("is_background") & (F.coalesce("extreme_share", F.lit(0.0)) >= share)))
