"""The registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import scalars as sc
from tessella.operators import augment, balance, dataset, features, imageops, stats, tiling, variants
from tessella.plans import adapters as fx
from tessella.registry import ORACLE_SQL, QUERIES, query
from tessella.sinks import writers
from tessella.sources import labels as lb
from tessella.sources import listing

SIZE, RATIO = 256, 0.3

_SAMPLES = """
 ranked AS (SELECT doc_id AS sample_id, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents),
 cut AS (SELECT *, least(CAST(round_even(n * 70 / 100.0, 0) AS BIGINT), n) AS a FROM ranked),
 splits AS (SELECT sample_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + least(CAST(round_even(n * 20 / 100.0, 0) AS BIGINT), n - a) THEN 'valid' ELSE 'test' END AS split FROM cut),
 files AS (SELECT doc_id AS sample_id, list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL) AS classes FROM labels),
 samples AS (SELECT s.sample_id, s.split, f.sample_id IS NOT NULL AS has_label, coalesce(f.classes, []) AS classes, coalesce(len(f.classes), 0) = 0 AS is_background
             FROM splits s LEFT JOIN files f USING (sample_id))"""
_INDEX = _SAMPLES + """,
 idx AS (SELECT split, sample_id, unnest(classes) AS class_id FROM samples),
 per_class AS (SELECT split, class_id, count(*) AS samples FROM idx GROUP BY ALL)"""
_POLYGONS = """
 polys AS (SELECT vec_id, label AS class_id, list_transform(range(0, len(embedding) // 2), lambda i: {'x': (CAST(embedding[2*i+1] AS DOUBLE) + 1) / 2, 'y': (CAST(embedding[2*i+2] AS DOUBLE) + 1) / 2}) AS p FROM embeddings)"""
_RASTERS = """
 rasters AS (SELECT p_partkey AS raster_id, p_size * 64 AS cols, (51 - p_size) * 64 AS nrows FROM part)"""
_TILES = _RASTERS + """,
 dims AS (SELECT raster_id, CAST(ceil((cols - 1e-9) / 179.0) AS BIGINT) AS nx, CAST(ceil((nrows - 1e-9) / 179.0) AS BIGINT) AS ny FROM rasters),
 ys AS (SELECT *, unnest(range(0, ny)) AS iy FROM dims),
 xs AS (SELECT *, unnest(range(0, nx)) AS ix FROM ys),
 tiles AS (SELECT raster_id, iy * nx + ix + 1 AS tile_id, CAST(ix * 179 AS DOUBLE) AS xmin, CAST(iy * 179 AS DOUBLE) AS ymin, CAST(ix * 179 + 256 AS DOUBLE) AS xmax, CAST(iy * 179 + 256 AS DOUBLE) AS ymax FROM xs)"""
_BOXES = """
 boxes AS (SELECT raster_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id, CAST(0.5 AS DOUBLE) + l_discount * 5 AS confidence,
   CAST((l_orderkey * 37 + l_linenumber * 101) % cols AS DOUBLE) AS bx, CAST((l_orderkey * 53 + l_linenumber * 211) % nrows AS DOUBLE) AS byy, CAST(l_quantity AS DOUBLE) AS q, CAST(l_orderkey AS BIGINT) * 10000 + l_linenumber * 1000 + rn AS det_id
   FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_discount, l_returnflag) AS rn FROM lineitem) JOIN rasters ON l_partkey = raster_id)"""


@query("split_assign", f"WITH {_SAMPLES} SELECT sample_id, split FROM splits")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_assign(fx.images(spark, d), fx.TRAIN, fx.VAL, fx.SEED)


@query("split_stats", f"""WITH {_SAMPLES} SELECT split, count(*) AS images, count(*) FILTER (has_label) AS label_files, count(*) FILTER (NOT has_label) AS missing,
  count(*) FILTER (len(classes) = 0) AS empty, count(*) FILTER (len(classes) > 0) AS with_objects, CAST(sum(len(classes)) AS BIGINT) AS objects FROM samples GROUP BY split""")
def _(spark, d):
    return stats.split_stats(fx.samples(spark, d))


@query("class_objects", f"WITH {_INDEX}, k AS (SELECT split, class_id, count(*) AS n FROM idx GROUP BY split, class_id) SELECT split, string_agg(concat(class_id, ':', n), ',' ORDER BY class_id) AS class_objects FROM k GROUP BY split")
def _(spark, d):
    each = F.transform(F.map_entries("class_objects"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return stats.class_counts(fx.samples(spark, d)).withColumn("class_objects", F.array_join(each, ","))


@query("class_share", f"WITH {_INDEX} SELECT split, class_id, samples AS objects, samples * CAST(100.0 AS DOUBLE) / sum(samples) OVER (PARTITION BY split) AS share FROM per_class")
def _(spark, d):
    return stats.class_share(fx.samples(spark, d)).withColumn("share", F.col("share").cast("double"))


@query("class_index", f"WITH {_INDEX} SELECT split, class_id, samples FROM per_class")
def _(spark, d):
    return stats.class_index(fx.samples(spark, d))


@query("balance_targets", f"""WITH {_INDEX} SELECT split, count(*) AS classes, greatest(1, min(samples)) AS minimum, greatest(1, CAST(round_even(avg(samples), 0) AS BIGINT)) AS average,
  greatest(1, CAST(round_even(median(samples), 0) AS BIGINT)) AS median FROM per_class GROUP BY split""")
def _(spark, d):
    return balance.targets(fx.samples(spark, d))


_BUDGET = _SAMPLES + """,
 sums AS (SELECT split, count(*) FILTER (NOT is_background) AS objects, count(*) FILTER (is_background) AS before FROM samples GROUP BY split),
 budget AS (SELECT *, CASE WHEN before = 0 THEN before ELSE CAST(floor(objects * CAST(0.2 AS DOUBLE) / (CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS BIGINT) END AS allowed FROM sums)"""


@query("background_budget", f"""WITH {_BUDGET} SELECT split, objects, before, allowed, least(before, allowed) AS after, before - least(before, allowed) AS removed,
  CASE WHEN before = 0 THEN 'disabled_or_no_background' WHEN before > allowed THEN 'trimmed' ELSE 'within_limit' END AS reason FROM budget""")
def _(spark, d):
    return balance.background_budget(fx.samples(spark, d), 20, True)


_TRIMMED = _BUDGET + """,
 bg AS (SELECT split, sample_id, row_number() OVER (PARTITION BY split ORDER BY md5(concat('7:', sample_id)), sample_id) AS r FROM samples WHERE is_background),
 trimmed AS (SELECT * FROM samples s WHERE NOT EXISTS (SELECT 1 FROM bg JOIN budget b USING (split) WHERE bg.split = s.split AND bg.sample_id = s.sample_id AND r > allowed))"""


@query("background_trim", f"WITH {_TRIMMED} SELECT split, sample_id FROM trimmed")
def _(spark, d):
    return balance.background_trim(fx.samples(spark, d), 20, True, fx.SEED).select("split", "sample_id")


def _downsample_sql(source: str) -> str:
    return f""",
 tidx AS (SELECT sample_id, unnest(classes) AS class_id FROM {source} WHERE split = 'train'),
 tcount AS (SELECT class_id, count(*) AS n FROM tidx GROUP BY class_id),
 goal AS (SELECT greatest(1, CAST(round_even(median(n), 0) AS BIGINT)) AS target, count(*) AS k FROM tcount),
 tr AS (SELECT sample_id, row_number() OVER (PARTITION BY class_id ORDER BY md5(concat('7:', sample_id)), sample_id) AS r FROM tidx),
 gone AS (SELECT DISTINCT sample_id FROM tr, goal WHERE k > 1 AND r > target)
 SELECT split, sample_id FROM {source} WHERE NOT (split = 'train' AND sample_id IN (SELECT sample_id FROM gone))"""


@query("class_downsample", f"WITH {_SAMPLES}{_downsample_sql('samples')}")
def _(spark, d):
    return balance.downsample(fx.samples(spark, d), "median", fx.SEED).select("split", "sample_id")


@query("post_process", f"WITH {_TRIMMED}{_downsample_sql('trimmed')}")
def _(spark, d):
    return balance.post_process(fx.samples(spark, d), 20, True, "median", fx.SEED).select("split", "sample_id")


@query("totals_rollup", f"WITH {_SAMPLES} SELECT split, count(*) AS images, CAST(sum(len(classes)) AS BIGINT) AS labels FROM samples GROUP BY ROLLUP (split)")
def _(spark, d):
    return dataset.totals(fx.samples(spark, d))


_PERCENT = "regexp_replace(regexp_replace(CAST(round(CAST(k * CAST(100.0 AS DOUBLE) / objects AS DECIMAL(28,12)), 2) AS VARCHAR), '0+$', ''), '[.]$', '')"


@query("dataset_report", f"""WITH {_TRIMMED}, kept AS (SELECT * FROM trimmed WHERE split <> 'test'),
 st AS (SELECT split, count(*) AS images, count(*) FILTER (has_label) AS files, count(*) FILTER (NOT has_label) AS missing, count(*) FILTER (len(classes) = 0) AS empty, count(*) FILTER (len(classes) > 0) AS w, CAST(sum(len(classes)) AS BIGINT) AS objects FROM kept GROUP BY split),
 cl AS (SELECT split, class_id, count(*) AS k FROM (SELECT split, unnest(classes) AS class_id FROM kept) GROUP BY split, class_id),
 lines AS (SELECT split, string_agg(concat('    class ', class_id, ': ', k, ' (', {_PERCENT}, '%)'), chr(10) ORDER BY class_id) AS c FROM cl JOIN st USING (split) GROUP BY split),
 names AS (SELECT * FROM (VALUES (0, 'train'), (1, 'valid'), (2, 'test')) t(split_no, split))
 SELECT split_no, split, CASE WHEN images IS NULL THEN concat('- ', split, ': not found') ELSE concat('- ', split, ':', chr(10), '  images: ', images, chr(10), '  label files: ', files, chr(10), '  missing label files: ', missing, chr(10),
  '  empty annotations: ', empty, chr(10), '  images with objects: ', w, chr(10), '  total objects: ', objects, chr(10), CASE WHEN c IS NULL THEN '  class balance: no objects' ELSE concat('  class balance:', chr(10), c) END) END AS text
 FROM names LEFT JOIN st USING (split) LEFT JOIN lines USING (split)""")
def _(spark, d):
    """Of the trimmed samples without the test split, which is then told as not found."""
    return stats.report_lines(balance.background_trim(fx.samples(spark, d), 20, True, fx.SEED).where("split <> 'test'"))


@query("report_join", f"""WITH {_TRIMMED},
 b AS (SELECT split, count(*) AS images, CAST(sum(len(classes)) AS BIGINT) AS objects FROM samples WHERE split <> 'valid' GROUP BY split),
 f AS (SELECT split, count(*) AS images, CAST(sum(len(classes)) AS BIGINT) AS objects FROM trimmed GROUP BY split)
 SELECT split, f.images, f.objects, coalesce(b.images, 0) AS base_images, coalesce(b.objects, 0) AS base_objects FROM f LEFT JOIN b USING (split)""")
def _(spark, d):
    s = fx.samples(spark, d)
    final, base = (stats.split_stats(x).select("split", "images", "objects") for x in (balance.background_trim(s, 20, True, fx.SEED), s.where("split <> 'valid'")))
    return stats.report(base, final)


@query("build_summary", f"""WITH {_SAMPLES}, t AS (SELECT split, count(*) AS images, CAST(sum(len(classes)) AS BIGINT) AS labels FROM samples GROUP BY split)
 SELECT concat('{{"layers":["quality","toxic"],"dataset_type":"Detection","split":{{', string_agg(concat('"', split, '":{{"images":', images, ',"labels":', labels, '}}'), ',' ORDER BY split),
  '}},"total_images":', CAST(sum(images) AS BIGINT), ',"total_labels":', CAST(sum(labels) AS BIGINT), '}}') AS json FROM t""")
def _(spark, d):
    return writers.build_summary(dataset.totals(fx.samples(spark, d)), ["quality", "toxic"], "Detection")


@query("tile_grid", f"WITH {_TILES} SELECT raster_id, tile_id, concat('tile_', tile_id) AS tile_name, xmin, ymin, xmax, ymax FROM tiles")
def _(spark, d):
    return tiling.tile_grid(fx.rasters(spark, d), SIZE, RATIO)


@query("tile_rings", f"""WITH {_TILES}, c AS (SELECT *, CAST(xmin AS BIGINT) AS a, CAST(ymin AS BIGINT) AS b, CAST(xmax AS BIGINT) AS c, CAST(ymax AS BIGINT) AS d FROM tiles)
 SELECT raster_id, tile_id, concat(a, ' ', b, ',', c, ' ', b, ',', c, ' ', d, ',', a, ' ', d, ',', a, ' ', b) AS ring FROM c""")
def _(spark, d):
    text = lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))
    return tiling.with_ring(tiling.tile_grid(fx.rasters(spark, d), SIZE, RATIO)).select("raster_id", "tile_id", F.array_join(F.transform("ring", text), ",").alias("ring"))


@query("tile_stats", f"WITH {_TILES} SELECT count(*) AS total_tiles, 77 AS overlap_px FROM tiles")
def _(spark, d):
    return tiling.tile_stats(tiling.tile_grid(fx.rasters(spark, d), SIZE, RATIO), SIZE, RATIO)


@query("alias_join", """WITH g AS (SELECT s_suppkey AS row_no, lower(trim(s_name)) AS key, regexp_extract(lower(trim(s_name)), '([0-9]+)$', 1) AS dg FROM supplier),
 s AS (SELECT *, left(key, len(key) - len(dg)) AS p, TRY_CAST(dg AS BIGINT) AS n FROM g),
 c AS (SELECT *, CASE WHEN p LIKE '%\\_' ESCAPE '\\' THEN left(p, len(p) - 1) ELSE p END AS cp FROM s),
 o AS (SELECT row_no, 0 AS pos, key AS alias FROM c UNION ALL SELECT row_no, 1, cp || n FROM c WHERE n IS NOT NULL
       UNION ALL SELECT row_no, 2, p || (n - 1) FROM c WHERE n > 0 UNION ALL SELECT row_no, 3, cp || (n - 1) FROM c WHERE n > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY row_no, pos) AS k FROM o)
 SELECT alias, row_no, pos FROM r WHERE k = 1""")
def _(spark, d):
    return tiling.aliases(fx.grid_names(spark, d))


@query("spatial_join", f"""WITH {_TILES}, {_BOXES.strip()}, j AS (SELECT t.*, class_id, confidence, greatest(bx, xmin) AS x1, greatest(byy, ymin) AS y1, least(bx + q, xmax) AS x2, least(byy + q, ymax) AS y2
  FROM tiles t JOIN boxes b ON t.raster_id = b.raster_id AND bx <= xmax AND xmin <= bx + q AND byy <= ymax AND ymin <= byy + q)
 SELECT raster_id, tile_id, class_id, ((x1 + x2) * CAST(0.5 AS DOUBLE) - xmin) / 256 AS cx, (ymax - (y1 + y2) * CAST(0.5 AS DOUBLE)) / 256 AS cy, (x2 - x1) / 256 AS w, (y2 - y1) / 256 AS h
 FROM j WHERE x2 > x1 AND y2 > y1""")
def _(spark, d):
    j = tiling.box_tiles(fx.rasters(spark, d), fx.boxes(spark, d), SIZE, RATIO)
    return geo.unit_boxes(j).select("raster_id", "tile_id", "class_id", "cx", "cy", "w", "h")


@query("polygon_area", f"""WITH {_POLYGONS} SELECT vec_id, round(abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y))) / 2, 9) AS area FROM polys""")
def _(spark, d):
    return fx.polygons(spark, d).select("vec_id", F.round(geo.area(F.col("points")), 9).alias("area"))


@query("hull_bbox", f"""WITH {_POLYGONS} SELECT vec_id, list_min(list_transform(p, lambda q: q.x)) AS xmin, list_min(list_transform(p, lambda q: q.y)) AS ymin,
  list_max(list_transform(p, lambda q: q.x)) AS xmax, list_max(list_transform(p, lambda q: q.y)) AS ymax FROM polys""")
def _(spark, d):
    return fx.polygons(spark, d).select("vec_id", geo.hull(F.col("points")).alias("h")).select("vec_id", "h.*")


@query("vertex_mean", f"WITH {_POLYGONS} SELECT vec_id, round(list_avg(list_transform(p, lambda q: q.x)), 9) AS x, round(list_avg(list_transform(p, lambda q: q.y)), 9) AS y FROM polys")
def _(spark, d):
    return fx.polygons(spark, d).select("vec_id", geo.vertex_mean(F.col("points")).alias("m")).select("vec_id", F.round("m.x", 9).alias("x"), F.round("m.y", 9).alias("y"))


@query("largest_polygon", f"""WITH {_POLYGONS}, a AS (SELECT class_id, vec_id, abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y))) / 2 AS area FROM polys),
 r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY area DESC, vec_id) AS k FROM a) SELECT class_id, vec_id, round(area, 9) AS area FROM r WHERE k = 1 AND area > 0""")
def _(spark, d):
    a = fx.polygons(spark, d).withColumn("area", geo.area(F.col("points")))
    best = a.groupBy("class_id").agg(F.max(F.struct("area", (-F.col("vec_id")).alias("order"))).alias("b")).where("b.area > 0")
    return best.select("class_id", (-F.col("b.order")).alias("vec_id"), F.round("b.area", 9).alias("area"))


#: Every point at its place counts in these sums.
_WEIGHED = "round(list_sum(list_transform(range(1, len({p}) + 1), lambda i: i * {p}[i].x)), 6) AS wx, round(list_sum(list_transform(range(1, len({p}) + 1), lambda i: i * {p}[i].y)), 6) AS wy"


def _weighed(points: str = "points") -> list[Column]:
    each = lambda c: F.round(F.aggregate(F.transform(points, lambda p, i: (i + 1) * p[c]), F.lit(0.0), lambda s, v: s + v), 6)
    return [each("x").alias("wx"), each("y").alias("wy")]


_VARIANT_SQL = {"rot90": ("1 - q.y", "q.x"), "rot180": ("1 - q.x", "1 - q.y"), "rot270": ("q.y", "1 - q.x"), "fliph": ("1 - q.x", "q.y"), "flipv": ("q.x", "1 - q.y"), "fliph_rot90": ("1 - q.y", "1 - q.x"), "fliph_rot270": ("q.y", "q.x")}


@query("affine_variants", f"WITH {_POLYGONS} " + " UNION ALL ".join(f"SELECT vec_id, tag, list_min(list_transform(v, lambda q: q.x)) AS xmin, list_max(list_transform(v, lambda q: q.y)) AS ymax, {_WEIGHED.format(p='v')} FROM (SELECT vec_id, '{t}' AS tag, list_transform(p, lambda q: {{'x': {x}, 'y': {y}}}) AS v FROM polys)" for t, (x, y) in _VARIANT_SQL.items()))
def _(spark, d):
    v = augment.exact_variants(fx.polygons(spark, d)).withColumn("h", geo.hull(F.col("points")))
    return v.select("vec_id", "tag", "h.xmin", "h.ymax", *_weighed())


_DONORS = """
 o AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat('7:', vec_id)), vec_id) - 1 AS no, count(*) OVER () AS n FROM embeddings),
 dn AS (SELECT a.vec_id, s AS slot, b.vec_id AS donor FROM o a, range(0, 4) t(s), o b WHERE b.no = (a.no + s) % a.n)"""


@query("mosaic_labels", f"""WITH {_POLYGONS}, {_DONORS.strip()}, m AS (SELECT dn.vec_id, slot, class_id, list_transform(p, lambda q: {{'x': (slot % 2) * CAST(0.5 AS DOUBLE) + q.x / 2, 'y': (slot // 2) * CAST(0.5 AS DOUBLE) + q.y / 2}}) AS p FROM dn JOIN polys ON polys.vec_id = donor)
 SELECT vec_id, CAST(slot AS INTEGER) AS slot, class_id, list_min(list_transform(p, lambda q: q.x)) AS xmin, list_max(list_transform(p, lambda q: q.y)) AS ymax, {_WEIGHED.format(p='p')} FROM m""")
def _(spark, d):
    p = fx.polygons(spark, d)
    donors = augment.with_self(augment.donors(p, 3, fx.SEED, "vec_id"), p, "vec_id")
    return augment.mosaic(p, donors, "vec_id").withColumn("h", geo.hull(F.col("points"))).select("vec_id", "slot", "class_id", "h.xmin", "h.ymax", *_weighed())


@query("mixup_labels", f"WITH {_POLYGONS}, {_DONORS.strip()} SELECT vec_id, class_id, {_WEIGHED.format(p='p')} FROM polys UNION ALL SELECT dn.vec_id, class_id, {_WEIGHED.format(p='p')} FROM dn JOIN polys ON polys.vec_id = donor WHERE slot = 1")
def _(spark, d):
    p = fx.polygons(spark, d)
    return augment.mixup(p, augment.donors(p, 1, fx.SEED, "vec_id"), "vec_id").select("vec_id", "class_id", *_weighed())


@query("crop_labels", f"""WITH {_POLYGONS}, c AS (SELECT vec_id, list_transform(p, lambda q: greatest(0, least(1, (q.x - CAST(0.25 AS DOUBLE)) / CAST(0.5 AS DOUBLE)))) AS xs, list_transform(p, lambda q: greatest(0, least(1, (q.y - CAST(0.25 AS DOUBLE)) / CAST(0.5 AS DOUBLE)))) AS ys FROM polys)
 SELECT vec_id, list_min(xs) AS xmin, list_max(ys) AS ymax FROM c WHERE list_max(xs) - list_min(xs) >= CAST(1e-4 AS DOUBLE) AND list_max(ys) - list_min(ys) >= CAST(1e-4 AS DOUBLE)""")
def _(spark, d):
    c = augment.crop(F.col("points"), F.lit(0.25), F.lit(0.25), F.lit(0.5))
    return fx.polygons(spark, d).withColumn("c", c).where("c is not null").withColumn("h", geo.hull(F.col("c"))).select("vec_id", "h.xmin", "h.ymax")


_PARTS = "list_filter(string_split(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' '), lambda t: len(t) > 0)"
_LINES = f"""
 src AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, CAST(l_orderkey % 9 + CAST(0.6 AS DOUBLE) AS DOUBLE) AS c, l_quantity / 64 AS q, l_discount AS dd, l_tax AS t FROM lineitem)"""


@query("label_parse", f"""WITH {_LINES} SELECT l_orderkey, l_linenumber,
  CASE WHEN k IN (0, 1) THEN CAST(trunc(c) AS INTEGER) END AS object_class, CASE k WHEN 0 THEN 'bbox' WHEN 1 THEN 'poly' END AS source_kind,
  CASE WHEN k <> 3 THEN CAST(trunc(c) AS INTEGER) END AS class_only, CASE WHEN k IN (0, 1, 4) THEN CAST(round_even(c, 0) AS INTEGER) END AS report_class,
  CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 END AS n_points,
  round(CASE k WHEN 0 THEN 4 * q WHEN 1 THEN q + t + dd END, 8) AS sum_x, round(CASE k WHEN 0 THEN 4 * dd WHEN 1 THEN dd + q + dd END, 8) AS sum_y,
  round(CASE k WHEN 0 THEN q - t / 2 WHEN 1 THEN q END, 8) AS first_x, round(CASE k WHEN 0 THEN dd + q / 2 WHEN 1 THEN dd END, 8) AS last_y FROM src""")
def _(spark, d):
    o = lb.parse_object(F.col("line"))
    total = lambda c: F.round(F.aggregate("o.points", F.lit(0.0), lambda s, p: s + p[c]), 8)
    return fx.label_lines(spark, d).withColumn("o", o).select("l_orderkey", "l_linenumber", F.col("o.class_id").alias("object_class"), "o.source_kind", lb.parse_class(F.col("line")).alias("class_only"), lb.parse_report_class(F.col("line")).alias("report_class"), F.size("o.points").alias("n_points"), total("x").alias("sum_x"), total("y").alias("sum_y"), F.round(F.try_element_at("o.points", F.lit(1))["x"], 8).alias("first_x"), F.round(F.try_element_at("o.points", F.lit(-1))["y"], 8).alias("last_y"))


@query("label_format", f"""WITH {_POLYGONS}, h AS (SELECT vec_id, class_id, p, list_min(list_transform(p, lambda q: q.x)) AS x1, list_min(list_transform(p, lambda q: q.y)) AS y1, list_max(list_transform(p, lambda q: q.x)) AS x2, list_max(list_transform(p, lambda q: q.y)) AS y2 FROM polys)
 SELECT vec_id, concat(class_id, ' ', array_to_string(list_transform(p, lambda q: printf('%.6f', q.x) || ' ' || printf('%.6f', q.y)), ' ')) AS poly,
  concat(class_id, ' ', printf('%.6f', x1 + (x2 - x1) * CAST(0.5 AS DOUBLE)), ' ', printf('%.6f', y1 + (y2 - y1) * CAST(0.5 AS DOUBLE)), ' ', printf('%.6f', x2 - x1), ' ', printf('%.6f', y2 - y1)) AS box FROM h""")
def _(spark, d):
    line = lambda kind: writers.label_line(F.col("class_id"), F.col("points"), F.lit(kind))
    return fx.polygons(spark, d).select("vec_id", line("poly").alias("poly"), line("bbox").alias("box"))


def _detections(spark, d) -> DataFrame:
    """Boxes as detections in pixels of their raster; masks are a triangle, the box, and the box moved by
    half its side."""
    b = fx.boxes(spark, d)
    half = (F.col("xmax") - F.col("xmin")) / 2
    xy = lambda *p: F.array(*(F.array(F.col(x), F.col(y)) for x, y in p))
    quad = xy(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))
    masks = F.array(xy(("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax")), quad, F.transform(quad, lambda p: F.transform(p, lambda v: v + half)))
    box = F.when(F.col("class_id") == 2, F.lit(None)).otherwise(F.array("xmin", "ymin", "xmax", "ymax"))
    d_ = b.select("raster_id", "det_id", F.col("class_id").cast("string").alias("class"), "confidence", box.alias("bbox_xyxy"), masks.alias("mask_polygons_px"))
    r = fx.rasters(spark, d).select("raster_id", F.col("cell_x").alias("pixel_w"), F.col("cell_y").alias("pixel_h"), "xmin", "ymin", "xmax", "ymax", F.concat(F.lit("raster_"), F.col("raster_id").cast("string")).alias("source_img"))
    return d_.join(r, "raster_id")


@query("detection_json", f"""WITH {_RASTERS}, {_BOXES.strip()} SELECT raster_id, CAST(row_number() OVER (PARTITION BY raster_id ORDER BY det_id) - 1 AS INTEGER) AS ord, CAST(class_id AS VARCHAR) AS class, confidence,
  CASE WHEN class_id <> 2 THEN bx END AS x1, CASE WHEN class_id <> 2 THEN byy + q END AS y2, 3 AS polygons, byy + q AS triangle_y, bx + q / 2 AS moved_x FROM boxes""")
def _(spark, d):
    text = writers.detections_json(_detections(spark, d), ["raster_id"], ["det_id"])
    back = listing.parse_detections(text, "json")
    at = lambda i, j, k: F.element_at(F.element_at(F.element_at("mask_polygons_px", i), j), k)
    return back.select("raster_id", "ord", "class", "confidence", F.try_element_at("bbox_xyxy", F.lit(1)).alias("x1"), F.try_element_at("bbox_xyxy", F.lit(4)).alias("y2"), F.size("mask_polygons_px").alias("polygons"), at(1, 3, 2).alias("triangle_y"), at(3, 1, 1).alias("moved_x"))


@query("feature_points", f"WITH {_RASTERS}, {_BOXES.strip()} SELECT det_id, round(bx + q / 2, 6) AS x, round(nrows - (byy + q / 2), 6) AS y, confidence, concat('raster_', raster_id) AS source_img FROM boxes JOIN rasters USING (raster_id)")
def _(spark, d):
    p = features.points(features.prepared(_detections(spark, d)))
    return p.select("det_id", F.round("geometry.x", 6).alias("x"), F.round("geometry.y", 6).alias("y"), "confidence", "source_img")


@query("feature_boxes", f"WITH {_RASTERS}, {_BOXES.strip()} SELECT det_id, raster_id, bx AS x1, nrows - (byy + q) AS y1, bx + q AS x2, nrows - byy AS y2, confidence, CAST(class_id AS VARCHAR) AS class FROM boxes JOIN rasters USING (raster_id) WHERE class_id <> 2 AND confidence >= CAST(0.6 AS DOUBLE)")
def _(spark, d):
    b = features.boxes(features.prepared(_detections(spark, d), 0.6))
    at = lambda i: F.element_at("geometry", i)
    return b.select("det_id", F.substring_index("source_img", "_", -1).cast("long").alias("raster_id"), at(1)["x"].alias("x1"), at(1)["y"].alias("y1"), at(3)["x"].alias("x2"), at(3)["y"].alias("y2"), "confidence", "class")


@query("feature_masks", f"WITH {_RASTERS}, {_BOXES.strip()} SELECT det_id, round(q * q, 6) AS area, bx AS xmin, nrows - byy AS ymax, 5 AS corners FROM boxes JOIN rasters USING (raster_id) WHERE q > 0")
def _(spark, d):
    m = features.masks(features.prepared(_detections(spark, d))).withColumn("h", geo.hull(F.col("geometry")))
    return m.select("det_id", F.round(geo.area(F.col("geometry")), 6).alias("area"), "h.xmin", "h.ymax", F.size("geometry").alias("corners"))


@query("seed_hash", """WITH RECURSIVE t AS (SELECT c_custkey, c_name, 1 AS i, CAST(17 AS BIGINT) AS h FROM customer UNION ALL
  SELECT c_custkey, c_name, i + 1, ((h * 31 + unicode(substr(c_name, i, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM t WHERE i <= len(c_name))
 SELECT c_custkey, abs(h) AS seed FROM t WHERE i = len(c_name) + 1""")
def _(spark, d):
    return fx.read(spark, d, "customer").select("c_custkey", sc.seed_hash(F.col("c_name")).alias("seed"))


@query("yaml_key", "SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(lower(trim(p_name || ' (90°)/' || p_type)), '°', ''), '(', ''), ')', ''), '/', '_'), '&', 'and'), '-', '_'), ' ', '_') AS key FROM part")
def _(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", sc.yaml_key(F.concat("p_name", F.lit(" (90°)/"), "p_type")).alias("key"))


@query("experiment_name", "SELECT p_partkey, '20240101_000000_' || p_size || 'px_conf' || lpad(CAST(CAST(round_even(p_size / 50.0 * 10, 0) AS INTEGER) AS VARCHAR), 2, '0') || '_' || p_brand AS name FROM part")
def _(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", sc.detection_name(F.lit("20240101_000000"), F.col("p_size"), F.col("p_size") / 50.0, F.col("p_brand")).alias("name"))


@query("rebalance_shares", """WITH s AS (SELECT p_partkey, p_size AS c, p_size % 7 AS a, p_size % 11 AS b FROM part), r AS (SELECT *, greatest(100 - c, 0) AS lft, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) ELSE 0.5 END AS ratio FROM s),
 n AS (SELECT *, CAST(round(lft * ratio) AS BIGINT) AS n1, CAST(round(lft * (1 - ratio)) AS BIGINT) AS n2 FROM r)
 SELECT p_partkey, greatest(0, least(100, CASE WHEN n1 >= n2 THEN n1 + 100 - c - n1 - n2 ELSE n1 END)) AS first, greatest(0, least(100, CASE WHEN n1 >= n2 THEN n2 ELSE n2 + 100 - c - n1 - n2 END)) AS second FROM n""")
def _(spark, d):
    s = F.col("p_size")
    return fx.read(spark, d, "part").select("p_partkey", sc.rebalance(s, s % 7, s % 11).alias("r")).select("p_partkey", "r.first", "r.second")


_COPIES = "(CASE WHEN p_size % 12 > 0 THEN least(8, 1 + p_size % 12) ELSE 1 END + CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END)"


@query("estimate", f"SELECT p_partkey, {_COPIES} AS copies, p_size * 900 * {_COPIES} AS images, CAST(p_size * 900 * {_COPIES} / 20.0 AS DOUBLE) AS seconds, p_size * 900 * {_COPIES} > 100000 AS warn, strftime(TIMESTAMP '2000-01-01' + to_seconds(p_size * 900 * {_COPIES} // 20), '%H:%M:%S') AS span FROM part")
def _(spark, d):
    s = F.col("p_size")
    e = fx.read(spark, d, "part").select("p_partkey", sc.estimate(s * 900, s % 12, s % 3).alias("e"))
    return e.select("p_partkey", "e.copies", "e.images", F.col("e.seconds").cast("double").alias("seconds"), "e.warn", sc.hms(F.col("e.seconds")).alias("span"))


@query("layer_resolve", "WITH r AS (SELECT n_nationkey AS class_id, '  ' || upper(n_name) AS name FROM nation), f AS (SELECT lower(trim(n_name)) AS k, arg_min(n_name, n_nationkey) AS layer, min(n_nationkey) AS layer_no FROM nation WHERE n_regionkey <> 2 GROUP BY 1) SELECT class_id, name, layer, layer_no FROM r JOIN f ON lower(trim(name)) = k")
def _(spark, d):
    n = fx.read(spark, d, "nation")
    return listing.resolve_layers(n.select(F.col("n_nationkey").alias("class_id"), F.concat(F.lit("  "), F.upper("n_name")).alias("name")), n.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("layer_no"), F.col("n_name").alias("name")))


@query("preset_join", "SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value, CASE WHEN n_regionkey = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS prob, n_regionkey = 1 AS enabled FROM nation")
def _(spark, d):
    n = fx.read(spark, d, "nation")
    options = n.select(F.col("n_name").alias("name"), F.lit(0.0).alias("value"), F.lit(1.0).alias("prob"), F.lit(False).alias("enabled"))
    preset = n.where("n_regionkey = 1").select(F.lower("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("value"), F.lit(0.5).alias("prob"), F.lit(True).alias("enabled"))
    return listing.apply_preset(options, preset)


_EXT = "['tif', 'tiff', 'img', 'vrt', 'png'][1 + CAST(s_suppkey % 5 AS INTEGER)]"


@query("ortho_pick", f"WITH f AS (SELECT s_nationkey AS folder, s_name || '.' || {_EXT} AS path, 1 + s_suppkey % 5 AS r FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY r, path) AS n FROM f WHERE r < 5) SELECT folder, path FROM k WHERE n = 1")
def _(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("tif", "tiff", "img", "vrt", "png"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return listing.pick_ortho(fx.read(spark, d, "supplier").select(F.col("s_nationkey").alias("folder"), F.concat_ws(".", "s_name", ext).alias("path")))


@query("nms")
def _(spark, d):
    return features.suppress(_detections(spark, d)).select("raster_id", "det_id", "class")


@query("obb", f"WITH {_RASTERS}, {_BOXES.strip()} SELECT det_id, round(bx, 6) AS xmin, round(nrows - (byy + 1.5 * q), 6) AS ymin, round(bx + 1.5 * q, 6) AS xmax, round(nrows - byy, 6) AS ymax, round(2.25 * q * q, 6) AS area FROM boxes JOIN rasters USING (raster_id)")
def _(spark, d):
    """Round the box and its moved copy the least rectangle is upright."""
    o = features.oriented(features.prepared(_detections(spark, d))).withColumn("h", geo.hull(F.col("geometry")))
    return o.select("det_id", *(F.round(f"h.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.round(geo.area(F.col("geometry")), 6).alias("area"))


@query("polygon_union", f"WITH {_RASTERS}, {_BOXES.strip()} SELECT det_id, 1 AS rings, 9 AS corners, round(1.75 * q * q, 6) AS area, round(bx, 6) AS xmin, round(nrows - byy, 6) AS ymax FROM boxes JOIN rasters USING (raster_id)")
def _(spark, d):
    """Of the box and its moved copy: one ring of eight corners."""
    u = features.masks(features.prepared(_detections(spark, d)), "union")
    ring = F.transform(F.element_at("geometry", 1), lambda p: geo.point(p[0], p[1]))
    u = u.select("det_id", F.size("geometry").alias("rings"), ring.alias("ring")).withColumn("h", geo.hull(F.col("ring")))
    return u.select("det_id", "rings", F.size("ring").alias("corners"), F.round(geo.area(F.col("ring")), 6).alias("area"), F.round("h.xmin", 6).alias("xmin"), F.round("h.ymax", 6).alias("ymax"))


def _pixels(k: int) -> np.ndarray:
    """A small image made by rule from a raster's number."""
    y, x = np.mgrid[:24, :32]
    return np.stack([(x * k + y) % 256, (x + y * k) % 256, (x * y + k) % 256], 2).astype(np.uint8)


def _images(spark, d) -> DataFrame:
    """Those images of the rasters."""

    def make(frames):
        for f in frames:
            rows = [_pixels(k).tobytes() for k in f["raster_id"]]
            yield f.assign(image_id=f["raster_id"], height=24, width=32, data=rows)[["image_id", "height", "width", "data"]]

    # Ids are few bytes and images many: without a number of parts one task would make them all.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fx.rasters(spark, d).select("raster_id").repartition(parts, "raster_id").mapInPandas(make, "image_id long, height int, width int, data binary")


def _with_objects(images: DataFrame) -> DataFrame:
    """Two objects an image, a box and a triangle."""
    at = lambda *p: F.array(*(geo.point(x, y) for x, y in p))
    one = lambda c, ring, kind: F.struct((F.col("image_id") % c).cast("int").alias("class_id"), ring.alias("points"), F.lit(kind).alias("source_kind"))
    return images.withColumn("objects", F.array(one(3, at((0.1, 0.2), (0.5, 0.2), (0.5, 0.6), (0.1, 0.6)), "bbox"), one(5, at((0.3, 0.3), (0.9, 0.4), (0.4, 0.8)), "poly")))


def _samples(spark, d) -> DataFrame:
    return _with_objects(_images(spark, d))


#: Every random option on.
_OPTIONS = {
    n: {"enabled": True, "value": a, "value_min": a, "value_max": b, "prob": 0.4}
    for n, a, b in (
        ("shear_x", -8, 8), ("shear_y", -8, 8), ("scale", 0.8, 1.2), ("translate_x", -0.1, 0.1), ("translate_y", -0.1, 0.1), ("perspective", 0, 0.05), ("random_crop", 0.6, 0.95),
        ("mosaic_4_img", 1, 1), ("mixup", 0.2, 0.6), ("copy_paste", 1, 4), ("hue", 0, 0.1), ("saturation", 0.8, 1.2), ("value_brightness", 0.8, 1.2), ("contrast", 0.8, 1.2), ("clahe", 1, 3),
        ("grayscale", 0, 1), ("solarize", 100, 200), ("posterize", 3, 7), ("equalize", 0, 1), ("auto_contrast", 0, 2), ("gaussian_blur", 1, 5), ("median_blur", 1, 3), ("gaussian_noise", 1, 8),
        ("salt_and_pepper", 0, 0.05), ("random_shadow", 0.1, 0.5), ("rain_fog", 0.1, 0.4), ("cutout", 0.1, 0.3), ("erasing", 0.1, 0.3),
    )
}


def _written(v: DataFrame) -> DataFrame:
    """Variants as name, digest of the pixels, label text and what acted."""
    line = lambda o: writers.label_line(o["class_id"].cast("int"), o["points"], o["source_kind"])
    text = F.array_join(F.filter(F.transform("objects", line), lambda x: x.isNotNull()), "\n")
    name = augment.variant_name(F.concat(F.lit("img_"), F.col("image_id").cast("string")), F.col("tag"))
    return v.select(name.alias("name"), F.md5("data").alias("digest"), text.alias("labels"), F.array_join("steps", ",").alias("steps"), F.round("extreme_share", 6).alias("extreme_share"))


@query("image_ops")
def _(spark, d):
    """Images are made where they are used: as large as they are, ten donors each were sent round."""
    ids = fx.rasters(spark, d).select(F.col("raster_id").alias("image_id"))
    return _written(variants.random_variants(_with_objects(ids), _OPTIONS, 2, fx.SEED, _pixels))


@query("image_variants")
def _(spark, d):
    return _written(variants.exact_variants(_samples(spark, d), ("rot90", "rot180", "rot270", "fliph", "flipv", "fliph_rot90", "fliph_rot270")))


@query("tile_images")
def _(spark, d):
    return imageops.cut_tiles(_images(spark, d), 16, 11).select("image_id", "tile_id", F.length("png").alias("bytes"))


@query("copy_paste_labels", f"""WITH {_POLYGONS}, {_DONORS.strip()}, px AS (SELECT vec_id, list_transform(p, lambda q: greatest(0, round_even(q.x * 639, 0))) AS xs, list_transform(p, lambda q: greatest(0, round_even(q.y * 639, 0))) AS ys FROM polys),
 ok AS (SELECT vec_id FROM px WHERE least(list_max(xs), 639) - list_min(xs) + 1 >= 2 AND least(list_max(ys), 639) - list_min(ys) + 1 >= 2)
 SELECT polys.vec_id, 1 + count(ok.vec_id) AS objects FROM polys JOIN dn ON dn.vec_id = polys.vec_id AND slot = 1 LEFT JOIN ok ON ok.vec_id = donor GROUP BY polys.vec_id""")
def _(spark, d):
    p = fx.polygons(spark, d).withColumn("object_ord", F.lit(0))
    return augment.copy_paste(p, augment.donors(p, 1, fx.SEED, "vec_id"), 3, 640, 640, fx.SEED, "vec_id").groupBy("vec_id").agg(F.count("*").alias("objects"))


from tessella import catalog_labels, catalog_values  # noqa: E402, F401  they register their queries
