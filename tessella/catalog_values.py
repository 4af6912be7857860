"""Registered queries of scalar rules: parsing, names, paths, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as sc
from tessella.operators import annotate
from tessella.plans import adapters as fx
from tessella.registry import query
from tessella.sources import listing

#: Texts that a field may hold, given to parts in turn.
_TEXTS = ("1.7", "x", "", " 2 ", "true", "YES", "on", "0", "-3.9", "1e2", "Union", " minimum", "Average", "largest", "all", "segmentation", "Detection ", "OBB")
_SQL_TEXTS = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + "][1 + CAST(p_partkey % " + str(len(_TEXTS)) + " AS INTEGER)]"


def _texts(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", "p_size", F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int")).alias("t"))


@query("parse_values", f"""WITH v AS (SELECT p_partkey, {_SQL_TEXTS} AS t FROM part)
 SELECT p_partkey, coalesce(TRY_CAST(t AS DOUBLE), CAST(-1 AS DOUBLE)) AS number, coalesce(CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INTEGER), 7) AS whole, lower(trim(t)) IN ('1', 'true', 'yes', 'on') AS truth,
  CASE WHEN lower(trim(t)) IN ('largest', 'union') THEN lower(trim(t)) ELSE 'largest' END AS mask_mode, CASE WHEN lower(trim(t)) IN ('minimum', 'average') THEN lower(trim(t)) ELSE 'median' END AS method,
  CASE WHEN lower(trim(t)) IN ('detection', '') THEN 'detection' WHEN lower(trim(t)) = 'segmentation' THEN 'segmentation' ELSE 'obb' END AS label_mode FROM v""")
def _(spark, d):
    t = F.col("t")
    return _texts(spark, d).select("p_partkey", sc.to_double(t, -1).alias("number"), sc.to_int(t, 7).alias("whole"), sc.to_bool(t, False).alias("truth"), sc.mask_mode(t).alias("mask_mode"), sc.balance_method(t).alias("method"), annotate.label_mode(t).alias("label_mode"))


@query("parse_lists", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' || ' || p_type || '|', '|'), lambda x: trim(x)), lambda x: len(x) > 0), '/') AS items FROM part")
def _(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(sc.words(F.concat("p_name", F.lit(" || "), "p_type", F.lit("|")), r"\|"), "/").alias("items"))


@query("dataset_names", "SELECT p_partkey, concat('20240102_030405_', p_size, '_', lower(trim(p_type)), CASE WHEN p_size % 2 = 0 THEN '_aug' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '_debug' ELSE '' END) AS name, concat('20240102_030405_', p_size, '_dataset') AS plain FROM part")
def _(spark, d):
    time, size = sc.stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")), F.col("p_size")
    return fx.read(spark, d, "part").select("p_partkey", sc.dataset_name(time, size, F.col("p_type"), size % 2 == 0, size % 3 == 0).alias("name"), sc.dataset_name(time, size, F.lit(None).cast("string"), F.lit(False), F.lit(False)).alias("plain"))


@query("path_rules", """SELECT p_partkey, concat('/P', p_size, '/Detection_Results') AS deep, concat('/P', p_size, '/Detection_Results') AS beside, concat('C:\\P', p_size, '\\a.prj') AS project, concat('c:\\p', p_size) AS key, CAST(NULL AS VARCHAR) AS none FROM part""")
def _(spark, d):
    p = F.concat(F.lit("P"), F.col("p_size").cast("string"))
    at = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    return fx.read(spark, d, "part").select("p_partkey", sc.detection_root(at("/", p, "/Tiles/640px")).alias("deep"), sc.detection_root(at("/", p, "/tiles/")).alias("beside"), sc.project_path(at(" file:///C:/", p, "/a.prj")).alias("project"), sc.project_key(at(" C:/", p, " ")).alias("key"), sc.project_path(F.lit("")).alias("none"))


_STEP = "CASE WHEN span <= CAST(0.01 AS DOUBLE) THEN CAST(0.0001 AS DOUBLE) WHEN span <= 1 THEN CAST(0.001 AS DOUBLE) WHEN span <= 10 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"


@query("spin_fields", f"WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * [CAST(0.0001 AS DOUBLE), 0.01, 0.1, 1][1 + CAST(p_partkey % 4 AS INTEGER)] AS span FROM part) SELECT p_partkey, {_STEP} AS step, CASE {_STEP} WHEN CAST(0.0001 AS DOUBLE) THEN 4 WHEN CAST(0.001 AS DOUBLE) THEN 3 WHEN CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS digits FROM s")
def _(spark, d):
    width = F.col("p_size").cast("double") * F.element_at(F.array(*map(F.lit, (0.0001, 0.01, 0.1, 1.0))), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = fx.read(spark, d, "part").select("p_partkey", F.lit(0.0).alias("low"), width.alias("high"))
    return s.select("p_partkey", sc.spin_step(F.col("low"), F.col("high")).alias("step"), sc.spin_precision(F.col("low"), F.col("high")).alias("digits"))


@query("option_limits", """WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 8 - 2 AS value, CAST(p_partkey % 40 AS DOUBLE) / 4 - 1 AS lo, CAST(p_partkey % 40 AS DOUBLE) / 4 AS hi, CAST(p_size AS DOUBLE) / 40 AS prob FROM part),
 a AS (SELECT *, round(CAST(least(greatest(0, least(4, lo)), hi) AS DECIMAL(18,6)), 1)::DOUBLE AS a FROM v),
 v1 AS (SELECT *, CASE WHEN a <> lo AND value < a THEN a ELSE value END AS w FROM a),
 b AS (SELECT *, round(CAST(greatest(greatest(0, least(4, hi)), a) AS DECIMAL(18,6)), 1)::DOUBLE AS b FROM v1),
 v2 AS (SELECT *, CASE WHEN b <> hi AND w > b THEN b ELSE w END AS w2 FROM b),
 v3 AS (SELECT *, round(CAST(greatest(0, least(4, w2)) AS DECIMAL(18,6)), 1)::DOUBLE AS z FROM v2)
 SELECT p_partkey, z AS value, CASE WHEN z <> w2 AND a > z THEN z ELSE a END AS value_min, CASE WHEN z <> w2 AND b < z THEN z ELSE b END AS value_max, round(CAST(greatest(0, least(1, prob)) AS DECIMAL(18,6)), 2)::DOUBLE AS prob FROM v3""")
def _(spark, d):
    """A field from 0 to 4: one decimal."""
    n = lambda c: F.col(c).cast("double")
    low = (F.col("p_partkey") % 40).cast("double") / 4
    o = sc.settle_option(n("p_size") / 8 - 2, low - 1, low, n("p_size") / 40, F.lit(0.0), F.lit(4.0), F.lit(0.0), F.lit(1.0))
    return fx.read(spark, d, "part").select("p_partkey", o.alias("o")).select("p_partkey", "o.*")


@query("recent_items", "WITH h AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey) SELECT n_regionkey, array_to_string((lower(names[2]) || '|' || array_to_string(list_filter(names, lambda x: x <> names[2]), '|')).string_split('|')[1:4], '|') AS items FROM h")
def _(spark, d):
    h = fx.read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    names = F.transform("l", lambda x: x["n_name"])
    return h.select("n_regionkey", F.array_join(sc.recent(names, F.lower(F.element_at(names, 2)), 4), "|").alias("items"))


@query("flat_polygons", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS polygons, CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 6 END AS points, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS DOUBLE) * 0 + 1 AS one FROM lineitem")
def _(spark, d):
    """Lists of six and of seven values, and one of four or six."""
    v = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double"))
    flat = F.array(v(6), F.when(F.col("l_linenumber") % 3 == 0, v(4)).otherwise(v(7)))
    i = fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", listing.flat_polygons(flat).alias("p"))
    return i.select("l_orderkey", "l_linenumber", F.size("p").alias("polygons"), F.aggregate("p", F.lit(0), lambda s, g: s + F.size(g)).alias("points"), F.element_at(F.element_at(F.element_at("p", 1), 1), 1).alias("one"))


_CONFIG = {"geometry": {"scale": {"value": 1.1, "value_min": 1.3, "value_max": 0.9, "prob": 0.5, "enabled": "yes"}, "flip_horizontal": True, "rotate_90_cw": "on"}, "color": {"hue": {"value": 0.1, "enabled": True}, "equalize": True}, "noise": {"rain_fog": {"value": "0.2", "prob": "x", "enabled": 1}}, "advanced": {"mixup": False}}


@query("config_options", """SELECT * FROM (VALUES ('scale', true, CAST(0.9 AS DOUBLE), CAST(1.3 AS DOUBLE), CAST(0.5 AS DOUBLE)), ('flip_horizontal', true, 1, 1, 1), ('rotate_90_cw', true, 1, 1, 1), ('hue', false, CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE), 0),
  ('equalize', true, 1, 1, 1), ('rain_fog', false, CAST(0.2 AS DOUBLE), CAST(0.2 AS DOUBLE), 0), ('mixup', false, 1, 1, 0)) t(name, acts, value_min, value_max, prob)""")
def _(spark, d):
    rows = [(n, listing.option_on(o), o["value_min"], o["value_max"], o["prob"]) for n, o in listing.options_of(_CONFIG).items()]
    return spark.createDataFrame(rows, "name string, acts boolean, value_min double, value_max double, prob double")
