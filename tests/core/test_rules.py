"""Rules worked by hand, and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import scalars as sc
from tessella.operators import balance, dataset, features, imageops, spatial, tiling
from tessella.operators.ranking import hash_rank
from tessella.sources import labels as lb
from tessella.sources import listing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("n,want", [(5, (4, 1, 0)), (25, (18, 5, 2)), (1, (1, 0, 0)), (0, (0, 0, 0))])
def test_split_counts(spark, n, want):
    got = {r.split: r["count"] for r in dataset.split_assign(spark.range(n).withColumnRenamed("id", "sample_id"), 70, 20, 3).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == want


def test_hash_rank_is_a_permutation(spark):
    rows = hash_rank(spark.range(500).withColumn("g", F.col("id") % 3), 5, "id", ["g"]).collect()
    for g in range(3):
        own = [r for r in rows if r.g == g]
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}


def test_label_readers(spark):
    lines = ["1.6 0.5 0.5 0.2 0.1", "0", "0 0.5", "0 0.1 0.2 0.3 0.4 0.5", "x 0.5 0.5 0.2 0.1", "", " 2  0.1 0.1 0.4 0.1 0.4 0.3 ", "-1 0.5 0.5 0.2 0.1"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(lb.parse_object(F.col("line"))["class_id"].alias("a"), lb.parse_class(F.col("line")).alias("b"), lb.parse_report_class(F.col("line")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [(1, 1, 2), (None, 0, None), (None, 0, 0), (None, 0, 0), (None, None, None), (None, None, None), (2, 2, 2), (-1, -1, None)]


def test_names(spark):
    r = one(spark, sc.confidence_tag(F.lit(0.25)).alias("a"), sc.detection_root(F.lit("/p/Tiles/640px")).alias("b"), sc.detection_root(F.lit("/p/tiles")).alias("c"), sc.yaml_key(F.lit(" Rain / Fog ")).alias("d"), sc.seed_hash(F.lit("")).alias("e"), sc.seed_hash(F.lit("ab")).alias("f"), sc.trailing_number(F.lit("t_007")).alias("g"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("conf02", "/p/Detection_Results", "/p/Detection_Results", "rain___fog", 17, (17 * 31 + 97) * 31 + 98) and (r.g.prefix, r.g.number) == ("t_", "7")


def test_grid(spark):
    r = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 358.0, 100.0), (2, 0.5, 0.5, 10.0, 10.0, 10.0, 20.0)], "raster_id long, cell_x double, cell_y double, xmin double, ymin double, xmax double, ymax double")
    rows = tiling.tile_grid(r, 256, 0.3).orderBy("tile_id").collect()
    assert [(x.tile_id, x.xmin, x.ymin, x.xmax) for x in rows] == [(1, 0.0, 0.0, 256.0), (2, 179.0, 0.0, 435.0)]
    with pytest.raises(ValueError):
        tiling.overlap_pixels(100, 1.0)


def test_aliases_first_row_wins(spark):
    g = spark.createDataFrame([(1, "t_2"), (2, "t_1"), (3, None), (4, " ")], "row_no long, name string")
    assert {r.alias: r.row_no for r in tiling.aliases(g).collect()} == {"t_2": 1, "t2": 1, "t_1": 1, "t1": 1, "t_0": 2, "t0": 2}


def test_geometry(spark):
    sq = geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    tri = F.array(geo.point(0, 0), geo.point(4, 0), geo.point(0, 4))
    r = one(spark, geo.area(sq).alias("a"), geo.centroid(sq).alias("c"), geo.closed(tri).alias("t"), geo.largest(F.array(tri, sq)).alias("l"), geo.area(geo.clip(tri, F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))).alias("k"), geo.largest(F.array(F.array(geo.point(0, 0)))).alias("none"))
    assert r.a == 2 and (r.c.x, r.c.y) == (1, 0.5) and r.t is None and len(r.l) == 3 and r.k == 4 and r.none is None


def test_flips_undo_themselves(spark):
    p = F.array(geo.point(0.25, 0.5), geo.point(0.75, 0.125))
    for a, b in (("fliph", "fliph"), ("flipv", "flipv"), ("rot90", "rot270"), ("rot180", "rot180")):
        r = one(spark, geo.variant(geo.variant(p, a), b).alias("q"), p.alias("p"))
        assert r.q == r.p


def test_spatial_join_equals_nested(spark):
    r = random.Random(3)
    make = lambda n, side: [(r.randrange(3), k, x := r.uniform(0, 300), y := r.uniform(0, 300), x + r.uniform(0, side), y + r.uniform(0, side)) for k in range(n)]
    a = spark.createDataFrame(make(80, 120), "g long, i long, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame(make(90, 40), "g long, j long, xmin double, ymin double, xmax double, ymax double")
    key = lambda df: sorted((x.g, x.i, x.j) for x in df.collect())
    assert key(spatial.box_join(a, b, ["g"], 50.0)) == key(spatial.nested_join(a, b, ["g"]))


def test_background_budget(spark):
    s = spark.createDataFrame([("train", k, k >= 8, []) for k in range(20)], "split string, sample_id long, is_background boolean, classes array<int>")
    r = balance.background_budget(s, 20, True).first()
    assert (r.objects, r.before, r.allowed, r.removed, r.reason) == (8, 12, 2, 10, "trimmed")
    assert balance.background_trim(s, 20, True, 1).count() == 10
    assert balance.background_budget(s, -1, False).first().reason == "disabled_or_no_background"


def test_downsample_unions_removals(spark):
    s = spark.createDataFrame([("train", k, False, [0] if k < 30 else [0, 1] if k < 40 else [1]) for k in range(45)], "split string, sample_id long, is_background boolean, classes array<int>")
    assert balance.target(s, "minimum").first().target == 15
    left = balance.downsample(s, "minimum", 2)
    gone = 45 - left.count()
    assert 25 <= gone <= 35 and balance.removals(s, "minimum", 2).count() == gone
    assert balance.downsample(s.where("sample_id < 30"), "minimum", 2).count() == 30


def test_suppression_equals_greedy(spark):
    r = random.Random(9)
    rows = [(1, k, "a", round(r.random(), 1), [x := r.uniform(0, 60), y := r.uniform(0, 60), x + r.uniform(5, 30), y + r.uniform(5, 30)]) for k in range(40)]
    got = {x.det_id for x in features.suppress(spark.createDataFrame(rows, "raster_id long, det_id long, class string, confidence double, bbox_xyxy array<double>")).collect()}
    kept = []
    for _, i, _, c, b in sorted(rows, key=lambda t: (-t[3], t[1])):
        size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
        both = lambda q: max(0, min(b[2], q[2]) - max(b[0], q[0])) * max(0, min(b[3], q[3]) - max(b[1], q[1]))
        if not any(both(q) > 0.5 * min(size(b), size(q)) for _, q in kept):
            kept.append((i, b))
    assert got == {i for i, _ in kept}


def test_rectangle_and_union():
    t = math.radians(30)
    turn = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    ring = np.array([[0, 0], [4, 0], [4, 1], [0, 1], [2, 0.5]]) @ turn.T
    q = features.min_rectangle(ring)
    sides = sorted(np.hypot(*(q[1] - q[0])) * k for k in (1,)) + [np.hypot(*(q[2] - q[1]))]
    assert np.isclose(sides[0] * sides[1], 4)
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    box = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    parts = features.slabs([box(0, 0, 2), box(1, 1, 2), box(10, 0, 1)])
    assert np.isclose(sum(map(area, parts)), 4 + 4 - 1 + 1)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert np.array_equal(imageops.warp(img, np.eye(3)), img) and np.array_equal(imageops.resize(img, 30, 20), img)
    assert np.abs(imageops.from_hsv(imageops.to_hsv(img)).astype(int) - img).max() <= 1
    assert np.array_equal(imageops.posterize(img, 8), img) and np.array_equal(imageops.equalize(img).shape, img.shape)
    (tmp_path / "a.png").write_bytes(imageops.to_png(img))
    r = listing.read_images(spark, str(tmp_path)).first()
    assert bytes(r.data) == img.tobytes() and (r.height, r.width) == (20, 30)
    assert imageops.extreme_share(np.zeros((2, 2, 3), np.uint8)) == 1.0


def test_detection_records(spark):
    text = '[{"class":"b","confidence":0.9,"bbox_xyxy":[1,2,3,4],"mask_polygons_px":[[[1,2],[5,2],[5,6],[1,6]]]},{"class":"r","confidence":0.4,"bbox_xyxy":null,"mask_polygons_px":[[[0,0],[4,0],[0,3]]]}]'
    d = listing.parse_detections(spark.createDataFrame([(text, 1), ('{"a":1}', 2), (None, 3)], "value string, k long"))
    rows = d.withColumn("det_id", F.col("ord").cast("long")).selectExpr("*", "1D pixel_w", "1D pixel_h", "0D xmin", "0D ymin", "10D xmax", "10D ymax", "'o' source_img")
    p = features.prepared(rows)
    assert features.masks(p).count() == 1 and features.boxes(p).count() == 1
    got = {r.det_id: (r.geometry.x, r.geometry.y) for r in features.points(p).collect()}
    assert got[0] == (3.0, 6.0) and np.allclose(got[1], (4 / 3, 9.0))
