"""Registered queries of tile labels, grids, images and dataset files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import scalars as sc
from tessella.operators import annotate, augment, balance, dataset, stats, tiling
from tessella.plans import adapters as fx
from tessella.registry import query
from tessella.sinks import writers
from tessella.sources import listing

SIZE, RATIO = 256, 0.3

_GRID = """
 rasters AS (SELECT p_partkey AS raster_id, p_size * 64 AS cols, (51 - p_size) * 64 AS nrows FROM part),
 dims AS (SELECT raster_id, CAST(ceil((cols - 1e-9) / 179.0) AS BIGINT) AS nx, CAST(ceil((nrows - 1e-9) / 179.0) AS BIGINT) AS ny FROM rasters),
 ys AS (SELECT *, unnest(range(0, ny)) AS iy FROM dims),
 xs AS (SELECT *, unnest(range(0, nx)) AS ix FROM ys),
 tiles AS (SELECT raster_id, iy * nx + ix + 1 AS tile_id, CAST(ix * 179 AS DOUBLE) AS xmin, CAST(iy * 179 AS DOUBLE) AS ymin, CAST(ix * 179 + 256 AS DOUBLE) AS xmax, CAST(iy * 179 + 256 AS DOUBLE) AS ymax FROM xs),
 items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_discount, l_returnflag) AS rn FROM lineitem),
 shapes AS (SELECT raster_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id, CAST(l_orderkey AS BIGINT) * 10000 + l_linenumber * 1000 + rn AS shape_no,
   CAST((l_orderkey * 37 + l_linenumber * 101) % cols AS DOUBLE) AS bx, CAST((l_orderkey * 53 + l_linenumber * 211) % nrows AS DOUBLE) AS byy, CAST(l_quantity AS DOUBLE) AS q FROM items JOIN rasters ON l_partkey = raster_id),
 cut AS (SELECT t.*, class_id, shape_no, greatest(bx, xmin) AS x1, greatest(byy, ymin) AS y1, least(bx + q, xmax) AS x2, least(byy + q, ymax) AS y2, byy + q > ymax AS over
   FROM tiles t JOIN shapes b ON t.raster_id = b.raster_id AND bx <= xmax AND xmin <= bx + q AND byy <= ymax AND ymin <= byy + q),
 inside AS (SELECT * FROM cut WHERE x2 > x1 AND y2 > y1),
 unit AS (SELECT *, printf('%.6f', (x1 - xmin) / 256) AS l, printf('%.6f', (x2 - xmin) / 256) AS r, printf('%.6f', (ymax - y1) / 256) AS b, printf('%.6f', (ymax - y2) / 256) AS t FROM inside)"""


def _texts(line: str) -> str:
    return f"""WITH {_GRID.strip()}, texts AS (SELECT raster_id, tile_id, string_agg(line, chr(10) ORDER BY class_id, shape_no) AS text, CAST(count(*) AS INTEGER) AS n_lines FROM (SELECT *, {line} AS line FROM unit) GROUP BY raster_id, tile_id)
 SELECT tiles.raster_id, tiles.tile_id, coalesce(text, '') AS text, coalesce(n_lines, 0) AS n_lines FROM tiles LEFT JOIN texts USING (raster_id, tile_id)"""


_DETECTION = "concat(class_id, ' ', printf('%.6f', ((x1 + x2) * CAST(0.5 AS DOUBLE) - xmin) / 256), ' ', printf('%.6f', (ymax - (y1 + y2) * CAST(0.5 AS DOUBLE)) / 256), ' ', printf('%.6f', (x2 - x1) / 256), ' ', printf('%.6f', (y2 - y1) / 256))"
# A ring that is cut at its upper side starts at the cut.
_SEGMENTATION = "CASE WHEN over THEN concat(class_id, ' ', l, ' ', t, ' ', l, ' ', b, ' ', r, ' ', b, ' ', r, ' ', t) ELSE concat(class_id, ' ', l, ' ', b, ' ', r, ' ', b, ' ', r, ' ', t, ' ', l, ' ', t) END"
# In the unit square y runs down: the rectangle starts at its least x and y.
_TURNED = "concat(class_id, ' ', l, ' ', t, ' ', r, ' ', t, ' ', r, ' ', b, ' ', l, ' ', b)"


def _lines(spark, d, mode: str):
    return annotate.shape_lines(annotate.cut_shapes(fx.shapes(spark, d), fx.rasters(spark, d), SIZE, RATIO), mode)


def _labels(spark, d, mode: str):
    return annotate.tile_labels(_lines(spark, d, mode), tiling.tile_grid(fx.rasters(spark, d), SIZE, RATIO))


@query("tile_labels_detection", _texts(_DETECTION))
def _(spark, d):
    return _labels(spark, d, "detection")


@query("tile_labels_segmentation", _texts(_SEGMENTATION))
def _(spark, d):
    return _labels(spark, d, "segmentation")


@query("tile_labels_obb", _texts(_TURNED))
def _(spark, d):
    return _labels(spark, d, "obb")


@query("dataset_build", f"""WITH {_GRID.strip()}, n AS (SELECT raster_id, tile_id, count(*) AS n_lines FROM inside GROUP BY raster_id, tile_id),
 s AS (SELECT raster_id * 100000 + tile_id AS sample_id, coalesce(n_lines, 0) AS n_lines, (tile_id % 10) / CAST(9.0 AS DOUBLE) AS extreme_share FROM tiles LEFT JOIN n USING (raster_id, tile_id)),
 k AS (SELECT *, row_number() OVER (ORDER BY md5(concat('7:', sample_id)), sample_id) AS r, count(*) OVER () AS n FROM s),
 c AS (SELECT *, least(CAST(round_even(n * 70 / 100.0, 0) AS BIGINT), n) AS a FROM k),
 sp AS (SELECT *, CASE WHEN r <= a THEN 'train' WHEN r <= a + least(CAST(round_even(n * 20 / 100.0, 0) AS BIGINT), n - a) THEN 'valid' ELSE 'test' END AS split FROM c)
 SELECT split, count(*) AS images, CAST(sum(n_lines) AS BIGINT) AS labels, count(*) FILTER (n_lines = 0) AS backgrounds FROM sp WHERE NOT (n_lines = 0 AND extreme_share >= CAST(0.985 AS DOUBLE)) GROUP BY ROLLUP (split)""")
def _(spark, d):
    """Tiles by split without near-empty ones (a made-up share of dark and light pixels)."""
    sample_id = (F.col("raster_id") * 100_000 + F.col("tile_id")).alias("sample_id")
    t = tiling.tile_grid(fx.rasters(spark, d), SIZE, RATIO).select(sample_id, ((F.col("tile_id") % 10) / F.lit(9.0)).alias("extreme_share"))
    counts = _lines(spark, d, "detection").groupBy(sample_id).agg(F.count("*").alias("n_lines"))
    b = annotate.built(t, fx.TRAIN, fx.VAL, fx.SEED, counts=counts)
    return b.rollup("split").agg(F.count("*").alias("images"), F.sum("n_lines").cast("long").alias("labels"), F.count_if("is_background").alias("backgrounds"))


@query("near_empty_images")
def _(spark, d):
    """Of images made by rule, those that a build keeps: pixels are read, labels decide first."""
    from tessella.catalog import _images
    from tessella.operators import imageops

    shown = imageops.extreme_shares(_images(spark, d)).withColumn("is_background", F.col("image_id") % 2 == 0)
    return dataset.drop_near_empty(shown, 0.2).select("image_id", F.round("extreme_share", 6).alias("extreme_share"))


_SUPPLIES = "SELECT concat('t_', s_suppkey % 40) AS name, s_suppkey AS row_no, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS xmin FROM supplier"


def _grid_rows(spark, d):
    s = fx.read(spark, d, "supplier")
    return s.select(F.concat(F.lit("t_"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.col("s_suppkey").alias("row_no"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey").cast("double")).alias("xmin"))


@query("grid_load", f"WITH g AS ({_SUPPLIES}) SELECT name, min(row_no) AS row_no, arg_max(xmin, row_no) AS xmin FROM g WHERE xmin IS NOT NULL GROUP BY name")
def _(spark, d):
    return tiling.load_grid(_grid_rows(spark, d))


@query("image_match", f"""WITH g0 AS ({_SUPPLIES}), g AS (SELECT name, min(row_no) AS row_no FROM g0 WHERE xmin IS NOT NULL GROUP BY name),
 s AS (SELECT row_no, name AS key, left(name, 1) AS cp, 't_' AS p, CAST(substr(name, 3) AS BIGINT) AS n FROM g),
 o AS (SELECT row_no, 0 AS pos, key AS alias FROM s UNION ALL SELECT row_no, 1, cp || n FROM s UNION ALL SELECT row_no, 2, p || (n - 1) FROM s WHERE n > 0 UNION ALL SELECT row_no, 3, cp || (n - 1) FROM s WHERE n > 0),
 a AS (SELECT alias, row_no FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY row_no, pos) AS k FROM o) WHERE k = 1),
 i AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(' T', c_custkey % 60) ELSE concat('t_', c_custkey % 60) END AS stem, CASE WHEN c_custkey % 5 = 0 THEN -c_custkey END AS own_row FROM customer)
 SELECT c_custkey, coalesce(own_row, row_no) AS row_no FROM i LEFT JOIN a ON lower(trim(stem)) = alias""")
def _(spark, d):
    k = F.col("c_custkey")
    number = (k % 60).cast("string")
    images = fx.read(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit(" T"), number)).otherwise(F.concat(F.lit("t_"), number)).alias("stem"), F.when(k % 5 == 0, -k).alias("own_row"))
    return tiling.match_images(images, tiling.load_grid(_grid_rows(spark, d))).select("c_custkey", "row_no")


@query("train_layers", "WITH n AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' train' WHEN n_nationkey % 3 = 1 THEN lower(n_regionkey || ' TRAIN') ELSE upper(n_regionkey || ' Train') END AS name FROM nation), one AS (SELECT min(name) AS name FROM n GROUP BY lower(name)) SELECT name, CAST(row_number() OVER (ORDER BY lower(name)) AS INTEGER) AS layer_no FROM one")
def _(spark, d):
    n = fx.read(spark, d, "nation")
    k, region = F.col("n_nationkey") % 3, F.col("n_regionkey").cast("string")
    name = F.when(k == 0, F.concat("n_name", F.lit(" train"))).when(k == 1, F.lower(F.concat(region, F.lit(" TRAIN")))).otherwise(F.upper(F.concat(region, F.lit(" Train"))))
    found = listing.annotation_layers(n.select(name.alias("name")).unionAll(n.select(F.col("n_name").alias("name"))))
    return tiling.number_rows(found.withColumn("_low", F.lower("name")), "_low", name="layer_no").drop("_low")


@query("image_paths", "WITH f AS (SELECT 'd/' || s_name || '.' || ['png', 'PNG', 'txt', 'jpeg', 'tif'][1 + CAST(s_suppkey % 5 AS INTEGER)] AS path FROM supplier) SELECT DISTINCT path FROM f WHERE lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp')")
def _(spark, d):
    """Two listings of the same files, lower and upper case patterns, as one."""
    ext = F.element_at(F.array(*map(F.lit, ("png", "PNG", "txt", "jpeg", "tif"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    files = fx.read(spark, d, "supplier").select(F.concat(F.lit("d/"), "s_name", F.lit("."), ext).alias("path"))
    images = files.where(listing.extension(F.col("path")).isin(*listing.IMAGE_EXTENSIONS))
    return listing.unite(images, images.where(F.col("path").endswith("PNG")))


@query("crop_random", """WITH polys AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: {'x': (CAST(embedding[2*i+1] AS DOUBLE) + 1) / 2, 'y': (CAST(embedding[2*i+2] AS DOUBLE) + 1) / 2}) AS p FROM embeddings),
 u AS (SELECT vec_id, p, CAST('0x' || substr(md5(concat('7:', vec_id, ':crop:prob')), 1, 13) AS BIGINT) / pow(16, 13) AS up, CAST('0x' || substr(md5(concat('7:', vec_id, ':crop:value')), 1, 13) AS BIGINT) / pow(16, 13) AS uv,
   CAST('0x' || substr(md5(concat('7:', vec_id, ':crop-x')), 1, 13) AS BIGINT) / pow(16, 13) AS ux, CAST('0x' || substr(md5(concat('7:', vec_id, ':crop-y')), 1, 13) AS BIGINT) / pow(16, 13) AS uy FROM polys),
 s AS (SELECT *, greatest(0.5, least(1.0, CAST(0.4 AS DOUBLE) + uv * (CAST(0.9 AS DOUBLE) - CAST(0.4 AS DOUBLE)))) AS s FROM u),
 c AS (SELECT vec_id, up <= CAST(0.7 AS DOUBLE) AS act, p, list_transform(p, lambda q: greatest(0, least(1, (q.x - ux * (1 - s)) / s))) AS xs, list_transform(p, lambda q: greatest(0, least(1, (q.y - uy * (1 - s)) / s))) AS ys FROM s)
 SELECT vec_id, round(CASE WHEN act THEN list_sum(xs) ELSE list_sum(list_transform(p, lambda q: q.x)) END, 6) AS sum_x, round(CASE WHEN act THEN list_sum(ys) ELSE list_sum(list_transform(p, lambda q: q.y)) END, 6) AS sum_y
 FROM c WHERE NOT act OR (list_max(xs) - list_min(xs) >= CAST(1e-4 AS DOUBLE) AND list_max(ys) - list_min(ys) >= CAST(1e-4 AS DOUBLE))""")
def _(spark, d):
    """One window per sample, in seven of ten."""
    c = augment.random_crop(fx.polygons(spark, d), {"enabled": True, "value_min": 0.4, "value_max": 0.9, "prob": 0.7}, fx.SEED, "vec_id")
    total = lambda k: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k]), 6)
    return c.select("vec_id", total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("variant_names", "SELECT concat('s', n_nationkey, '__rand', k) AS name FROM nation, range(1, 4) t(k)")
def _(spark, d):
    v = augment.random_variants(fx.read(spark, d, "nation").select("n_nationkey"), 3, True)
    return v.select(augment.variant_name(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")), F.col("tag")).alias("name"))


_H = [0.9, 0.1, 0.02, -0.05, 1.1, 0.01, 0.03, -0.02, 1.0]


@query("homography", f"""WITH polys AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: {{'x': (CAST(embedding[2*i+1] AS DOUBLE) + 1) / 2, 'y': (CAST(embedding[2*i+2] AS DOUBLE) + 1) / 2}}) AS p FROM embeddings),
 z AS (SELECT vec_id, list_transform(p, lambda q: {{'x': greatest(0, least(1, ({_H[0]} * q.x + {_H[1]} * q.y + {_H[2]}) / ({_H[6]} * q.x + {_H[7]} * q.y + {_H[8]}))), 'y': greatest(0, least(1, ({_H[3]} * q.x + {_H[4]} * q.y + {_H[5]}) / ({_H[6]} * q.x + {_H[7]} * q.y + {_H[8]})))}}) AS p FROM polys)
 SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: i * p[i].x)), 6) AS wx, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: i * p[i].y)), 6) AS wy FROM z""")
def _(spark, d):
    moved = fx.polygons(spark, d).withColumn("p", geo.homography(F.col("points"), _H))
    each = lambda k: F.round(F.aggregate(F.transform("p", lambda p, i: (i + 1) * p[k]), F.lit(0.0), lambda s, v: s + v), 6)
    return moved.select("vec_id", each("x").alias("wx"), each("y").alias("wy"))


@query("unit_points", "SELECT c_custkey, greatest(0, least(1, (CAST(c_custkey AS DOUBLE) - 10) / 90)) AS x, greatest(0, least(1, (CAST(80 AS DOUBLE) - c_nationkey * 4) / 80)) AS y, CAST(0 AS DOUBLE) AS flat_x FROM customer")
def _(spark, d):
    n = lambda v: F.lit(float(v))
    c = fx.read(spark, d, "customer")
    x, y = F.col("c_custkey").cast("double"), (F.col("c_nationkey") * 4).cast("double")
    return c.select("c_custkey", geo.to_unit(x, y, n(10), n(0), n(100), n(80)).alias("p"), geo.to_unit(x, y, n(5), n(0), n(5), n(80)).alias("f")).select("c_custkey", "p.x", "p.y", F.col("f.x").alias("flat_x"))


@query("budget_modes", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey WHEN n_nationkey % 4 = 1 THEN 0 WHEN n_nationkey % 4 = 2 THEN n_nationkey ELSE 6 END AS allowed FROM nation")
def _(spark, d):
    """No limit, a share of nothing, a share of everything, and a number of images."""
    n = F.col("n_nationkey").cast("long")
    of = lambda limit, percent: balance.budget(F.lit(100), n, limit, percent)
    k = n % 4
    return fx.read(spark, d, "nation").select("n_nationkey", F.when(k == 0, of(-1, True)).when(k == 1, of(0, True)).when(k == 2, of(100, True)).otherwise(of(6, False)).cast("long").alias("allowed"))


_OPTIONS = [("Geometry", 0, [("Rotate 90° CW", True, 0.0, True), ("Flip Horizontal", True, 0.0, False), ("Scale", False, 1.25, True), ("Shear X", False, -4.5, True)]), ("Color", 1, [("Hue", False, 0.015, True), ("Value (Brightness)", False, 1.1, False)]), ("Advanced", 2, [("MixUp", False, 0.3, True), ("Copy-Paste", False, 2.0, False)])]


def _options(spark):
    schema = "name string, exact boolean, value double, enabled boolean, option_no int, value_min double, value_max double, prob double"
    groups = {g.lower(): spark.createDataFrame([(*o, k, o[2] - 0.5, o[2] + 0.125, 0.35) for k, o in enumerate(own)], schema) for g, _, own in _OPTIONS}
    return listing.concat_groups(groups)


_CONFIG_TEXT = """seed: 7
geometry:
  rotate_90_cw: true
  flip_horizontal: false
  scale: {value: 1.25, value_min: 0.75, value_max: 1.375, prob: 0.35, enabled: true}
  shear_x: {value: -4.5, value_min: -5, value_max: -4.375, prob: 0.35, enabled: true}
color:
  hue: {value: 0.015, value_min: -0.485, value_max: 0.14, prob: 0.35, enabled: true}
  value_brightness: {value: 1.1, value_min: 0.6, value_max: 1.225, prob: 0.35, enabled: false}
advanced:
  mixup: {value: 0.3, value_min: -0.2, value_max: 0.425, prob: 0.35, enabled: true}
  copy_paste: {value: 2, value_min: 1.5, value_max: 2.125, prob: 0.35, enabled: false}
apply_to_val: true
apply_to_test: false
"""
_HYP_TEXT = "hsv_h: 0.015\nhsv_s: 1\nhsv_v: 1.1\ndegrees: 4.5\ntranslate: 0\nscale: 0.25\nshear: 4.5\nperspective: 0\nflipud: 0\nfliplr: 0\nmosaic: 0\nmixup: 0.35\ncopy_paste: 0\n"


def _literal(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


@query("config_yaml", f"SELECT {_literal(_CONFIG_TEXT)} AS text")
def _(spark, d):
    return writers.config_yaml(_options(spark), fx.SEED, True, False)


@query("hyp_yaml", f"SELECT {_literal(_HYP_TEXT)} AS text")
def _(spark, d):
    return writers.hyp_yaml(_options(spark))


@query("data_yaml", f"SELECT {_literal(writers.data_yaml(10))} AS text")
def _(spark, d):
    return spark.range(1).select(F.lit(writers.data_yaml(10)).alias("text"))


_SPLITS = """
 ranked AS (SELECT doc_id AS sample_id, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents),
 cut AS (SELECT *, least(CAST(round_even(n * 70 / 100.0, 0) AS BIGINT), n) AS a FROM ranked),
 splits AS (SELECT sample_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + least(CAST(round_even(n * 20 / 100.0, 0) AS BIGINT), n - a) THEN 'valid' ELSE 'test' END AS split FROM cut),
 samples AS (SELECT s.split, coalesce(l.quality, 0) = 1 OR coalesce(l.toxic, 0) = 1 AS has FROM splits s LEFT JOIN labels l ON l.doc_id = s.sample_id)"""


@query("augmentation_summary", f"""WITH {_SPLITS.strip()}, g AS (SELECT split, count(*) AS images, count(*) FILTER (has) AS objects, count(*) FILTER (NOT has) AS before FROM samples GROUP BY split),
 b AS (SELECT *, CAST(floor(objects * CAST(0.2 AS DOUBLE) / (CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS BIGINT) AS allowed FROM g)
 SELECT concat('{{"seed":7,"config":"c.yaml","dataset_root":"root","post_balance":{{"background_limit":20,"background_limit_is_percent":true,"class_balance":true,"balance_method":"median"}},"splits":[',
  string_agg(concat('{{"split":"', split, '","images":', images, ',"created":', 3 * images, '}}'), ',' ORDER BY split), '],"total_created":', CAST(sum(3 * images) AS BIGINT), ',"post_background":[',
  string_agg(concat('{{"split":"', split, '","before":', before, ',"after":', least(before, allowed), ',"removed":', before - least(before, allowed), ',"reason":"', CASE WHEN before = 0 THEN 'disabled_or_no_background' WHEN before > allowed THEN 'trimmed' ELSE 'within_limit' END, '"}}'), ',' ORDER BY split), ']}}') AS json FROM b""")
def _(spark, d):
    s = fx.samples(spark, d)
    created = s.groupBy("split").agg(F.count("*").alias("images"), (3 * F.count("*")).alias("created"))
    return writers.augmentation_summary(created, balance.background_budget(s, 20, True), fx.SEED, "c.yaml", "root", 20, True, True, " Median")


@query("report_text")
def _(spark, d):
    """The whole report, with the numbers that a build would give it."""
    s = fx.samples(spark, d)
    options = [{"name": "Scale", "value_min": 0.75, "value_max": 1.375, "prob": 0.35}]
    given = {"date": "2024-01-02 03:04:05", "ortho": "orthos", "tile_size": SIZE, "overlap": RATIO, "kind": "Detection", "experiment": "e", "debug": "disabled", "augmentation": "enabled", "train": fx.TRAIN, "val": fx.VAL, "test": 10, "background": "20%", "balancing": "enabled (median)", "seed": fx.SEED, "to_val": False, "to_test": False, "multiplier": 2, "source_images": 100, "all_images": 200, "options": options, "warnings": stats.warnings_of(SIZE, RATIO, 2, fx.TRAIN, 200)[1]}
    return stats.report_text(s, balance.background_trim(s, 20, True, fx.SEED), given)


@query("point_of_polygon", """WITH polys AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: {'x': (CAST(embedding[2*i+1] AS DOUBLE) + 1) / 2, 'y': (CAST(embedding[2*i+2] AS DOUBLE) + 1) / 2}) AS p FROM embeddings),
 c AS (SELECT vec_id, p, list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y) AS k, list_transform(range(1, len(p) + 1), lambda i: p[i].x + p[i % len(p) + 1].x) AS sx, list_transform(range(1, len(p) + 1), lambda i: p[i].y + p[i % len(p) + 1].y) AS sy FROM polys)
 SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: k[i] * sx[i])) / (3 * list_sum(k)), 5) AS x, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: k[i] * sy[i])) / (3 * list_sum(k)), 5) AS y FROM c WHERE abs(list_sum(k)) > 0.05""")
def _(spark, d):
    """The area's centre, of rings with some area."""
    from tessella.operators.features import polygon_point

    p = fx.polygons(spark, d).where(geo.area(F.col("points")) > 0.025).select("vec_id", polygon_point(F.col("points")).alias("c"))
    return p.select("vec_id", F.round("c.x", 5).alias("x"), F.round("c.y", 5).alias("y"))


@query("expected_tiles", "SELECT p_partkey, CAST(ceil((p_size * 64 - 1e-9) / 179.0) AS BIGINT) AS nx FROM part")
def _(spark, d):
    r = fx.rasters(spark, d)
    step = F.lit(float(SIZE - tiling.overlap_pixels(SIZE, RATIO)))
    return r.select(F.col("raster_id").alias("p_partkey"), tiling.tile_count("xmin", "xmax", step).alias("nx"))


@query("alpha_and_side", "SELECT p_partkey, CASE WHEN (p_size - 10) / CAST(20.0 AS DOUBLE) <= 0 THEN 0.5 ELSE least(1, (p_size - 10) / CAST(20.0 AS DOUBLE)) END AS alpha FROM part")
def _(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", augment.mixup_alpha((F.col("p_size") - 10) / F.lit(20.0)).cast("double").alias("alpha"))


@query("fixed_text", "SELECT p_partkey, printf('%.6f', CAST(p_size AS DOUBLE) / 128) AS a, printf('%.6f', CAST(p_retailprice AS DOUBLE) / 7) AS b, printf('%.6f', CAST(p_partkey AS DOUBLE) / 2000000) AS c FROM part")
def _(spark, d):
    """Ties, plain numbers, and halves of the last place that no binary number holds."""
    n = lambda c, k: sc.fixed(F.col(c).cast("double") / float(k))
    return fx.read(spark, d, "part").select("p_partkey", n("p_size", 128).alias("a"), n("p_retailprice", 7).alias("b"), n("p_partkey", 2_000_000).alias("c"))
