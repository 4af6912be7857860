"""File and layer listings, orthos, detections and configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions of tiles, and of orthos by priority.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
ORTHO_EXTENSIONS = ("tif", "tiff", "img", "vrt")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the image files of a folder, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder).select("path", "length")
    return files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).orderBy("path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (BGR rows); unreadable ones go."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def pick_ortho(files: DataFrame, by: str = "folder", path: str = "path") -> DataFrame:
    """The file of the best extension, then least name, of each folder."""
    rank = F.array_position(F.array(*map(F.lit, ORTHO_EXTENSIONS)), extension(F.col(path)))
    return files.withColumn("_rank", rank).where("_rank > 0").groupBy(by).agg(F.min(F.struct("_rank", path)).alias("best")).select(by, F.col(f"best.{path}").alias(path))


def annotation_layers(layers: DataFrame, name: str = "name") -> DataFrame:
    """Names that hold "train", one of each spelling by case, sorted."""
    low = F.lower(F.col(name))
    return layers.where(low.contains("train")).groupBy(low.alias("_low")).agg(F.min(name).alias(name)).orderBy("_low").select(name)


def resolve_layers(requested: DataFrame, layers: DataFrame) -> DataFrame:
    """Requested names (class_id, name) with the first layer (layer_no, name) of the same trimmed name
    in any case. Missing ones go and leave a gap in the ids."""
    key = F.lower(F.trim("name"))
    first = layers.groupBy(key.alias("key")).agg(F.min_by("name", "layer_no").alias("layer"), F.min("layer_no").alias("layer_no"))
    return requested.withColumn("key", key).join(first, "key").select("class_id", "name", "layer", "layer_no")


#: A detection record; a file that isn't a list of these has none.
DETECTION = "array<struct<class:string,confidence:double,bbox_xyxy:array<double>,mask_polygons_px:array<array<array<double>>>>>"


def parse_detections(text: DataFrame, value: str = "value") -> DataFrame:
    """One row per detection record, with its place, beside the other columns of the text rows."""
    rest = [c for c in text.columns if c != value]
    is_list = F.ltrim(F.col(value)).startswith("[")
    parsed = F.when(is_list, F.from_json(value, DETECTION))
    return text.select(*rest, F.posexplode(parsed).alias("ord", "d")).where("d is not null").select(*rest, "ord", F.col("d.class").alias("class"), "d.confidence", "d.bbox_xyxy", "d.mask_polygons_px")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return parse_detections(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))


def flat_polygons(flat: Column) -> Column:
    """Flat coordinate lists as polygons: lists under 6 values go, as do polygons under 3 points."""
    points = lambda f: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(f) / 2).cast("int") - 1, F.lit(0))), lambda i: F.array(F.element_at(f, 2 * i + 1), F.element_at(f, 2 * i + 2)))
    return F.filter(F.transform(F.filter(flat, lambda f: F.size(f) >= 6), points), lambda p: F.size(p) >= 3)


def load_config(path: str) -> dict:
    """An augmentation configuration: groups of options that are a bool or a record."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def option(config: dict, group: str, name: str) -> dict:
    """An option as a record, whichever way it is written. A bare true always acts, with value 1; a
    record without a probability never does; ends of a range may come in either order."""
    v = (config.get(group) or {}).get(name)
    if not isinstance(v, dict):
        on = truth(v)
        return {"enabled": on, "value": 1.0, "value_min": 1.0, "value_max": 1.0, "prob": 1.0 if on else 0.0}
    value = number(v.get("value"), 0.0)
    low, high = sorted((number(v.get("value_min"), value), number(v.get("value_max"), value)))
    return {"enabled": truth(v.get("enabled")), "value": value, "value_min": low, "value_max": high, "prob": number(v.get("prob"), 0.0)}


def number(v, default: float) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return default


def truth(v) -> bool:
    return v.strip().lower() in ("1", "true", "yes", "on") if isinstance(v, str) else bool(v)


def options_of(config: dict) -> dict[str, dict]:
    """Every option of the four groups by its name, in the groups' order."""
    return {n: option(config, g, n) for g in GROUPS for n in (config.get(g) or {})}


def option_on(v: dict) -> bool:
    return v["enabled"] and v["prob"] > 0


def random_on(config: dict) -> bool:
    """Whether any option that acts at random is on; exact turns and flips aren't random."""
    return any(option_on(o) for n, o in options_of(config).items() if n not in EXACT)


#: The groups of a configuration, and the options that make exact variants.
GROUPS = ("geometry", "color", "noise", "advanced")
EXACT = ("rotate_90_cw", "rotate_180", "rotate_270_cw", "flip_horizontal", "flip_vertical")


def exact_tags(config: dict) -> tuple[str, ...]:
    """The exact variants that a configuration turns on, a flip with a turn included."""
    geometry = config.get("geometry") or {}
    on = {t for t, n in zip(("rot90", "rot180", "rot270", "fliph", "flipv"), EXACT, strict=True) if truth(geometry.get(n))}
    return tuple(t for t in ("rot90", "rot180", "rot270", "fliph", "flipv", "fliph_rot90", "fliph_rot270") if all(part in on for part in t.split("_")))


def existing(*paths: str) -> str | None:
    """The first path that exists."""
    return next((p for p in paths if Path(p).exists()), None)


def grid_path(tiles: str, file: str = "Tile_Grid_Pixels.parquet") -> str | None:
    """The grid table beside a tiles folder's images, or one folder up."""
    return existing(str(Path(tiles) / "shapes" / file), str(Path(tiles).parent / "shapes" / file))


def read_summary(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Images and labels of a built dataset: from its summary, else by counting its files."""
    path = Path(folder) / "dataset_build_summary.json"
    try:
        got = json.loads(path.read_text(encoding="utf-8"))
        return int(got.get("total_images", 0)), int(got.get("total_labels", 0))
    except (OSError, ValueError, TypeError, AttributeError):
        return count_files(folder)


def count_files(folder: str) -> tuple[int, int]:
    """Image files and label files of the three splits."""
    of = lambda kind: (p for s in ("train", "valid", "test") for p in (Path(folder) / s / kind).glob("*"))
    images = sum(p.suffix.lower().removeprefix(".") in IMAGE_EXTENSIONS for p in of("images"))
    return images, sum(p.suffix == ".txt" for p in of("labels"))


def unite(*listings: DataFrame) -> DataFrame:
    """Paths of several listings, each once."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return out.distinct()


def concat_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """Option groups one after the other, with the group's name and place."""
    out = None
    for k, (name, rows) in enumerate(groups.items()):
        own = rows.withColumn("group", F.lit(name)).withColumn("group_no", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def load_preset(path: str) -> list[dict]:
    return json.loads(Path(path).read_text(encoding="utf-8")).get("options", [])


def apply_preset(options: DataFrame, preset: DataFrame) -> DataFrame:
    """Options (name, value, prob, enabled) with what the preset sets, by name in any case; unknown
    names of the preset are passed over."""
    low = lambda c: F.lower(F.trim(c))
    p = preset.select(low(F.col("name")).alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("value", "prob", "enabled")))
    j = options.withColumn("_key", low(F.col("name"))).join(p, "_key", "left")
    return j.select("name", *(F.coalesce(f"_{c}", c).alias(c) for c in ("value", "prob", "enabled")))
