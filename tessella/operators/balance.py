"""Background limits and class balance. Inputs are never changed: what goes is anti-joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import half_even
from tessella.operators.ranking import hash_rank
from tessella.operators.stats import class_index


def budget(objects: Column, backgrounds: Column, limit: int, percent: bool) -> Column:
    """Backgrounds that may stay: of a final share in percent, or a number; all for a negative limit."""
    if limit < 0:
        return backgrounds
    if not percent:
        return F.lit(limit).cast("long")
    p = min(max(limit / 100.0, 0.0), 1.0)
    return F.lit(0).cast("long") if p <= 0 else backgrounds if p >= 1 else F.floor(objects * p / (1.0 - p)).cast("long")


def background_budget(samples: DataFrame, limit: int, percent: bool) -> DataFrame:
    """Per split: samples with objects, backgrounds, allowed, kept, removed, and why."""
    sums = samples.groupBy("split").agg(F.count_if(~F.col("is_background")).alias("objects"), F.count_if("is_background").alias("before"))
    off = (F.col("before") == 0) | F.lit(limit < 0)
    allowed = F.when(off, F.col("before")).otherwise(budget(F.col("objects"), F.col("before"), limit, percent))
    out = sums.withColumn("allowed", allowed).withColumn("after", F.least("before", "allowed")).withColumn("removed", F.col("before") - F.col("after"))
    reason = F.when(off, "disabled_or_no_background").when(F.col("removed") > 0, "trimmed").otherwise("within_limit")
    return out.withColumn("reason", reason)


def background_trim(samples: DataFrame, limit: int, percent: bool, seed: int, key: str = "sample_id") -> DataFrame:
    """Samples without the backgrounds over the limit of their split, in a seeded order."""
    ranked = hash_rank(samples.where("is_background").select("split", key), seed, key, ["split"])
    over = ranked.join(F.broadcast(background_budget(samples, limit, percent).select("split", "allowed")), "split").where("rank > allowed").select("split", key)
    return samples.join(over, ["split", key], "left_anti")


def target(samples: DataFrame, method: str = "median") -> DataFrame:
    """Per split: classes and the samples each class may have. Means and medians round half to even."""
    n = F.col("samples")
    how = {"minimum": F.min(n), "average": half_even(F.avg(n))}.get((method or "").strip().lower(), half_even(F.median(n)))
    return class_index(samples).groupBy("split").agg(F.count("*").alias("classes"), F.greatest(F.lit(1).cast("long"), how).alias("target"))


def targets(samples: DataFrame) -> DataFrame:
    out = None
    for m in ("minimum", "average", "median"):
        own = target(samples, m).select("split", "classes", F.col("target").alias(m))
        out = own if out is None else out.join(own.drop("classes"), "split")
    return out


def removals(samples: DataFrame, method: str, seed: int, key: str = "sample_id", split: str = "train") -> DataFrame:
    """Samples over the target of any of their classes. Each class draws from all its samples, so a
    class may end below the target; with one class or none nothing goes."""
    own = samples.where(F.col("split") == split)
    index = own.select(key, F.explode(F.array_distinct("classes")).alias("class_id"))
    limit = target(own, method).where("classes > 1").select("target")
    ranked = hash_rank(index, seed, key, ["class_id"])
    return ranked.crossJoin(F.broadcast(limit)).where("rank > target").select(key).distinct()  # limit has one row


def downsample(samples: DataFrame, method: str, seed: int, key: str = "sample_id", split: str = "train") -> DataFrame:
    """Samples without the removals of the split; other splits stay whole."""
    gone = removals(samples, method, seed, key, split).withColumn("split", F.lit(split))
    return samples.join(gone, ["split", key], "left_anti")


def post_process(samples: DataFrame, limit: int, percent: bool, method: str, seed: int) -> DataFrame:
    """Both phases: classes are balanced on what the background limit left."""
    return downsample(background_trim(samples, limit, percent, seed), method, seed)
