"""Tile grids and the aliases under which images find their tile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import box_ring
from tessella.functions.scalars import one_less, trailing_number

GUARD = 1e-9


def overlap_pixels(size: int, ratio: float) -> int:
    """Half-even pixels of a ratio; a tile must step forward."""
    px = round(size * ratio)
    if not 0 <= px < size:
        raise ValueError("overlap must be at least 0 and below the tile size")
    return px


def tile_count(low: str, high: str, step: Column) -> Column:
    """How many tiles start within an extent."""
    return F.greatest(F.ceil((F.col(high) - F.col(low) - GUARD) / step).cast("long"), F.lit(0))


def tile_grid(rasters: DataFrame, size: int, ratio: float) -> DataFrame:
    """Tiles of each raster, rows from the bottom, columns from the left, while their start lies
    inside; edge tiles reach beyond. Coordinates are start + index * step, so they carry no summed
    rounding."""
    step = size - overlap_pixels(size, ratio)
    r = rasters.withColumn("_sx", step * F.col("cell_x")).withColumn("_sy", step * F.col("cell_y"))
    r = r.withColumn("_nx", tile_count("xmin", "xmax", F.col("_sx"))).withColumn("_ny", tile_count("ymin", "ymax", F.col("_sy"))).where("_nx > 0 and _ny > 0")
    r = r.withColumn("_iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny") - 1))).withColumn("_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx") - 1)))
    x, y = F.col("xmin") + F.col("_ix") * F.col("_sx"), F.col("ymin") + F.col("_iy") * F.col("_sy")
    tile_id = F.col("_iy") * F.col("_nx") + F.col("_ix") + 1
    return r.select("raster_id", tile_id.alias("tile_id"), F.concat(F.lit("tile_"), tile_id.cast("string")).alias("tile_name"), x.alias("xmin"), y.alias("ymin"), (x + size * F.col("cell_x")).alias("xmax"), (y + size * F.col("cell_y")).alias("ymax"))


def with_ring(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("ring", box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))


def tile_stats(tiles: DataFrame, size: int, ratio: float) -> DataFrame:
    return tiles.agg(F.count("*").alias("total_tiles")).withColumn("overlap_px", F.lit(overlap_pixels(size, ratio)))


def load_grid(grid: DataFrame) -> DataFrame:
    """Named rows of a grid table (name, row_no and more): the last of a name's rows, at the place of
    its first. Rows without a name, or without the extent's xmin, go."""
    rest = [c for c in grid.columns if c not in ("name", "row_no")]
    last = F.max_by(F.struct(*rest, F.col("row_no").alias("_no")), F.col("row_no"))
    whole = grid.where("name <> '' and xmin is not null") if "xmin" in rest else grid.where("name <> ''")
    return whole.groupBy("name").agg(F.min("row_no").alias("row_no"), last.alias("v")).select("name", "row_no", *(F.col(f"v.{c}").alias(c) for c in rest))


def aliases(grid: DataFrame) -> DataFrame:
    """alias -> row_no of the grid row that it finds. Each row offers its name, the name with the
    underscore before its number dropped, and both with the number less one; the first row to offer an
    alias keeps it."""
    key = F.lower(F.trim("name"))
    g = grid.select("row_no", key.alias("key")).where(F.length("key") > 0).withColumn("t", trailing_number(F.col("key")))
    p, n = F.col("t.prefix"), F.col("t.number")
    compact = F.when(p.endswith("_"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    offers = F.array(F.col("key"), F.concat(compact, n), F.concat(p, one_less(n)), F.concat(compact, one_less(n)))
    each = g.select("row_no", F.posexplode(offers).alias("pos", "alias")).where("alias is not null and alias <> ''")
    # min over (row, position) needs no sort and is summed before the shuffle
    return each.groupBy("alias").agg(F.min(F.struct("row_no", "pos")).alias("first")).select("alias", F.col("first.row_no").alias("row_no"), F.col("first.pos").alias("pos"))


def match_images(images: DataFrame, grid: DataFrame) -> DataFrame:
    """Images (stem and, where known, their own extent `own_row`) with the grid row they belong to:
    the own one, else the alias's."""
    named = images.withColumn("alias", F.lower(F.trim("stem"))).join(aliases(grid).drop("pos"), "alias", "left")
    return named.withColumn("row_no", F.coalesce("own_row", "row_no")) if "own_row" in images.columns else named


def expected_tiles(width: float, cell: float, size: int, ratio: float) -> int:
    return max(0, math.ceil((width - GUARD) / ((size - overlap_pixels(size, ratio)) * cell)))


def number_rows(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Row numbers from 1 by the order, for listings of names, layers or options."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def box_tiles(rasters: DataFrame, boxes: DataFrame, size: int, ratio: float) -> DataFrame:
    """Boxes (raster_id, xmin, ymin, xmax, ymax and more) with each tile of their raster's grid that they
    touch. Tiles lie on a lattice, so a box's tiles follow from its corners: no tile table is made or
    shuffled, and one look-up of the raster is the only join. The box comes back as r_xmin and so on."""
    step = size - overlap_pixels(size, ratio)
    r = rasters.select("raster_id", F.col("xmin").alias("_x"), F.col("ymin").alias("_y"), (step * F.col("cell_x")).alias("_sx"), (step * F.col("cell_y")).alias("_sy"), (size * F.col("cell_x")).alias("_w"), (size * F.col("cell_y")).alias("_h"), tile_count("xmin", "xmax", step * F.col("cell_x")).alias("_nx"), tile_count("ymin", "ymax", step * F.col("cell_y")).alias("_ny")).where("_nx > 0 and _ny > 0")
    named = boxes.withColumnsRenamed({c: f"r_{c}" for c in ("xmin", "ymin", "xmax", "ymax")})
    j = named.join(r, "raster_id")

    def along(rows: DataFrame, axis: str) -> DataFrame:
        """Rows with each place `_i<axis>` of the lattice that the box touches, and the tile's ends there."""
        start, step_, width, n, low, high = F.col(f"_{axis}"), F.col(f"_s{axis}"), F.col("_w" if axis == "x" else "_h"), F.col(f"_n{axis}"), F.col(f"r_{axis}min"), F.col(f"r_{axis}max")
        # One more on each side than the division gives; the comparison with the tile's ends decides.
        first = F.greatest(F.ceil((low - start - width) / step_).cast("long") - 1, F.lit(0))
        last = F.least(F.floor((high - start) / step_).cast("long") + 1, n - 1)
        near = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
        # The lambda keeps the explosion out of whole-stage code; alone it made no measurable difference.
        near = near.withColumn(f"_t{axis}", F.explode(F.transform(F.sequence("_first", "_last"), lambda i: F.struct(i.alias("i"), (start + i * step_).alias("low"))))).drop("_first", "_last")
        at = F.col(f"_t{axis}.low")
        return near.withColumns({f"{axis}min": at, f"{axis}max": at + width}).where((F.col(f"{axis}min") <= high) & (low <= F.col(f"{axis}max")))

    j = along(along(j, "y"), "x")
    return j.withColumn("tile_id", F.col("_ty.i") * F.col("_nx") + F.col("_tx.i") + 1).drop("_x", "_y", "_sx", "_sy", "_w", "_h", "_nx", "_ny", "_tx", "_ty")
