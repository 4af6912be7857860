"""Annotation statistics and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import shortest


def split_stats(samples: DataFrame) -> DataFrame:
    """Per split: images, label files, missing ones, empty ones (missing ones count too), images with
    objects, and objects."""
    n = F.size("classes")
    return samples.groupBy("split").agg(
        F.count("*").alias("images"),
        F.count_if("has_label").alias("label_files"),
        F.count_if(~F.col("has_label")).alias("missing"),
        F.count_if(n == 0).alias("empty"),
        F.count_if(n > 0).alias("with_objects"),
        F.sum(n).cast("long").alias("objects"),
    )


def class_share(samples: DataFrame) -> DataFrame:
    """Objects of each class and their share of the split in percent."""
    counts = samples.select("split", F.explode("classes").alias("class_id")).groupBy("split", "class_id").agg(F.count("*").alias("objects"))
    return counts.withColumn("share", F.col("objects") * 100.0 / F.sum("objects").over(Window.partitionBy("split")))


def class_index(samples: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Distinct samples of each class: a sample counts once for a class."""
    return samples.select(*keys, F.explode(F.array_distinct("classes")).alias("class_id")).groupBy(*keys, "class_id").agg(F.count("*").alias("samples"))


def report(base: DataFrame, final: DataFrame) -> DataFrame:
    """Final statistics beside the base ones; a split that the base lacks counts 0 there."""
    numbers = [c for c in final.columns if c != "split"]
    b = base.select("split", *(F.col(c).alias(f"base_{c}") for c in numbers))
    return final.join(b, "split", "left").select("split", *numbers, *(F.coalesce(f"base_{c}", F.lit(0)).alias(f"base_{c}") for c in numbers))


def class_counts(samples: DataFrame) -> DataFrame:
    """Per split: a map of the objects of each class, by class."""
    counts = samples.select("split", F.explode("classes").alias("class_id")).groupBy("split", "class_id").agg(F.count("*").alias("n"))
    return counts.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_id", "n")))).alias("class_objects"))


#: The splits and the labelled numbers of the report, in order.
SPLITS = ("train", "valid", "test")
NUMBERS = (("images", "images"), ("label files", "label_files"), ("missing label files", "missing"), ("empty annotations", "empty"), ("images with objects", "with_objects"), ("total objects", "objects"))


def report_lines(samples: DataFrame) -> DataFrame:
    """The report's part on annotations: one text per split, in the report's order (split_no). A split
    without samples is told as not found."""
    have = split_stats(samples).join(class_counts(samples), "split", "left")
    names = samples.sparkSession.createDataFrame([(k, s) for k, s in enumerate(SPLITS)], "split_no int, split string")
    share = lambda n: shortest(n.cast("double") * 100.0 / F.col("objects"), 2)
    each = F.transform(F.map_entries("class_objects"), lambda e: F.concat(F.lit("    class "), e["key"].cast("string"), F.lit(": "), e["value"].cast("string"), F.lit(" ("), share(e["value"]), F.lit("%)")))
    balance = F.when(F.coalesce(F.size("class_objects"), F.lit(0)) > 0, F.concat(F.lit("  class balance:\n"), F.array_join(each, "\n"))).otherwise("  class balance: no objects")
    lines = [F.concat(F.lit("- "), F.col("split"), F.lit(":")), *(F.concat(F.lit(f"  {text}: "), F.col(c).cast("string")) for text, c in NUMBERS), balance]
    text = F.when(F.col("images").isNull(), F.concat(F.lit("- "), F.col("split"), F.lit(": not found"))).otherwise(F.concat_ws("\n", *lines))
    return names.join(have, "split", "left").select("split_no", "split", text.alias("text"))


def report_text(base: DataFrame | None, final: DataFrame, given: dict) -> DataFrame:
    """One row with the whole report. base: samples before augmentation, or None; given: what was asked
    for (see REPORT) with the list of enabled options and of warnings."""
    part = lambda s: report_lines(s).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    after = part(final).select(F.concat(F.lit("\nPer-split annotation statistics (Final / after augmentation):\n"), "t").alias("after"))
    before = final.sparkSession.range(1).select(F.lit("").alias("before")) if base is None else part(base).select(F.concat(F.lit("\nPer-split annotation statistics (Base / before augmentation):\n"), "t", F.lit("\n")).alias("before"))
    head = REPORT.format(**given) + "".join(f"- {o['name']}: range=[{o['value_min']:g}..{o['value_max']:g}], prob={o['prob']:g}\n" for o in given["options"])
    warnings = "".join(f"- {w}\n" for w in given["warnings"])
    return before.crossJoin(after).select(F.concat(F.lit(head), "before", "after", F.lit("\n\nWarnings:\n" + warnings)).alias("text"))  # one row each


#: Fixed value: the report's head.
REPORT = """Dataset Report
==============
Date: {date}
Source ortho folder: {ortho}
Tile size: {tile_size}
Overlap: {overlap:g}
Dataset type: {kind}
Experiment: {experiment}

Modes:
- Debug: {debug}
- Augmentation: {augmentation}

Split:
- Train: {train}%
- Val: {val}%
- Test: {test}%
- Background limit: {background}
- Class balancing: {balancing}

Augmentation:
- Seed: {seed}
- Apply to Val: {to_val}
- Apply to Test: {to_test}
- Dataset multiplier: x{multiplier}
- Estimated source images: {source_images}
- Estimated images after augmentation: {all_images}

Enabled augmentations:
"""


def warnings_of(tile_size: int, overlap: float, layers: int, train: int, images: int) -> tuple[list[str], list[str]]:
    """What the settings are warned of (size, overlap, layers), and the report's own warnings."""
    checks = [(not 64 <= tile_size <= 2048, "Tile Size should be in range [64..2048]."), (not 0 <= overlap <= 0.9, "Overlap should be in range [0..0.9]."), (layers == 0, "Select at least one annotation layer.")]
    own = [text for wrong, text in checks if wrong]
    report = ([" ".join(own)] if own else []) + (["WARN: Train split is below 50%."] if train < 50 else [])
    report += (["Estimated dataset size exceeds 100,000 images."] if images > 100_000 else []) + (["Train split is below 50%."] if train < 50 else [])
    return own, report


def can_run(train: int, val: int, test: int, layers: int) -> str | None:
    """Why a build can't start, or None."""
    if train + val + test != 100:
        return "Split sum must be 100."
    return None if layers else "Select at least one annotation layer."
