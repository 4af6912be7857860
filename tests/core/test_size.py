"""What large tables need: expressions made once, whole batches at a time, no image sent to the driver."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella import catalog
from tessella.functions import geometry as geo
from tessella.operators import annotate, augment, features, imageops, variants

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cut_is_made_once(spark):
    for mode in ("detection", "segmentation", "obb"):
        text = plan(catalog.QUERIES[f"tile_labels_{mode}"](spark, SF))
        assert text.count("lambdafunction(CASE WHEN (size(lambda") <= 6, mode


def test_build_counts_without_texts(spark):
    text = plan(catalog.QUERIES["dataset_build"](spark, SF))
    assert "collect_list" not in text
    assert "lpad" not in text
    assert text.count("l_shipdate") == 1  # lineitem is read once


def test_boxes_are_cut_as_any_ring(spark):
    """A box against the same box with a corner more, which takes the general way."""
    boxes = [(k, x, y, x + 30.0, y + 17.0) for k, (x, y) in enumerate([(10.0, 10.0), (-5.0, 20.0), (85.0, 30.0), (40.0, -8.0), (50.0, 95.0), (-10.0, 90.0), (90.0, -10.0), (100.0, 10.0)])]
    d = spark.createDataFrame(boxes, "shape_no long, a double, b double, c double, d double")
    p = lambda x, y: geo.point(F.col(x), F.col(y))
    plain = F.array(p("a", "b"), p("c", "b"), p("c", "d"), p("a", "d"))
    more = F.array(p("a", "b"), geo.point((F.col("a") + F.col("c")) / 2, F.col("b")), p("c", "b"), p("c", "d"), p("a", "d"))
    rasters = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 100.0, 100.0)], "raster_id long, cell_x double, cell_y double, xmin double, ymin double, xmax double, ymax double")
    cut = lambda ring: annotate.cut_shapes(d.select(F.lit(1).cast("long").alias("raster_id"), "shape_no", F.lit(0).alias("class_id"), F.array(ring).alias("rings")), rasters, 60, 0.25)
    for mode in ("detection", "obb"):
        a, b = ({(r.tile_id, r.shape_no): r.line for r in annotate.shape_lines(cut(ring), mode).collect()} for ring in (plain, more))
        assert a == b and len(a) > 8
    ends = lambda rows: {(r.tile_id, r.shape_no): {tuple(q) for q in r.points} for r in rows.collect()}
    a, b = (ends(annotate.shape_lines(cut(ring), "segmentation")) for ring in (plain, more))
    assert a.keys() == b.keys() and all(a[k] <= b[k] for k in a)


def test_rectangles_of_many(spark):
    r = np.random.default_rng(3)
    p = np.concatenate([r.integers(0, 5, (300, 7, 2)).astype(float), r.normal(size=(300, 7, 2))])
    corners, ok = features.min_rectangles(p)
    for q, c, has in zip(p, corners, ok, strict=True):
        sides = [(b - a) / np.hypot(*(b - a)) for i, a in enumerate(q) for b in q[:i] if (a != b).any()]
        areas = [np.ptp(q @ u) * np.ptp(q @ [-u[1], u[0]]) for u in sides]
        if not has:
            assert not areas or min(areas) < 1e-9
            continue
        u, v = c[1] - c[0], c[3] - c[0]
        assert np.isclose(abs(u[0] * v[1] - u[1] * v[0]), np.hypot(*u) * np.hypot(*v)) and np.isclose(np.hypot(*u) * np.hypot(*v), min(areas))
        for along in (u, v):
            t = (q - c[0]) @ along / (along @ along)
            assert t.min() > -1e-9 and t.max() < 1 + 1e-9
    rows = [(1, [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0]]), (2, None), (3, [[0.0, 0.0], [1.0, 1.0]]), (4, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])]
    got = {x.k: x.r for x in spark.createDataFrame(rows, "k long, p array<array<double>>").select("k", features.rectangles(F.col("p")).alias("r")).collect()}
    assert got == {1: [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0]], 2: None, 3: None, 4: None}


def test_images_are_not_broadcast(spark):
    text = variants.samples_with_donors(catalog._samples(spark, SF), 2, 7)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in text.split("\n") if "BroadcastHashJoin" in line and ("donor" in line or "copy" in line)]
    assert not sent


def test_samples_are_sent_once_for_all_that_take_them(spark):
    """Against the donors by join: blocks that follow each other, that go on from the first, samples fewer than donors."""
    for n in (3, 135, 300):
        s = spark.range(n).select(F.col("id").alias("image_id"), F.array().cast(variants.OBJECTS).alias("objects"))
        want = {}
        for r in augment.donors(s, 10, 7, "image_id").collect():
            want.setdefault(r.image_id, {})[r.slot] = r.donor
        blocks = {}
        for r in variants.samples_with_donors(s, 2, 7).collect():
            assert r.at == len(blocks.setdefault(r.block, []))
            blocks[r.block].append(r.image_id)
        got = {rows[k]: dict(enumerate(rows[k + 1 : k + 11], 1)) for rows in blocks.values() for k in range(len(rows) - 10)}
        assert got == want and len(want) == n and sum(map(len, blocks.values())) == n + 10 * len(blocks) and len(blocks) == -(-n // variants.BLOCK)


def test_images_are_read_where_they_are_used(spark):
    plan = catalog.QUERIES["image_ops"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan.split("MapInArrow")[1]
    given = catalog._samples(spark, SF).where("image_id % 4 = 0")
    ids = given.select("image_id", "objects")
    a, b = (sorted(v.select("image_id", "tag", F.md5("data"), F.col("objects").cast("string"), "steps", "extreme_share").collect()) for v in (variants.random_variants(given, catalog._OPTIONS, 3, 5), variants.random_variants(ids, catalog._OPTIONS, 3, 5, catalog._pixels)))
    assert a == b and len(a) == 3 * given.count()


def test_label_numbers_are_named_once(spark):
    text = plan(catalog.QUERIES["image_ops"](spark, SF))
    assert text.count("1.34217729E8") <= 40  # 16 for each place where a number is rounded; 96 when each had its own


def test_shared_arrays_change_no_pixel(monkeypatch):
    """Kernels on small images, on images of another size meanwhile, and with nothing shared."""
    r = np.random.default_rng(4)
    images = [r.integers(0, 256, (*side, 3)).astype(np.uint8) for side in ((24, 32), (5, 9), (24, 32), (1, 1))]
    turn = imageops.shear_x(9) @ imageops.scale(0.8)
    kernels = (lambda i: imageops.clahe(i, 1.7), lambda i: imageops.resize(i, 7, 13), lambda i: imageops.warp(i, turn), lambda i: imageops.shadow(i, np.random.default_rng(2)))
    shared = [[k(i) for k in kernels] for i in images]
    monkeypatch.setattr(imageops, "SMALL", 0)
    assert all(np.array_equal(k(i), x) for i, own in zip(images, shared, strict=True) for k, x in zip(kernels, own, strict=True))
    y, x = np.meshgrid((np.arange(13) + 0.5) * 24 / 13 - 0.5, (np.arange(7) + 0.5) * 32 / 7 - 0.5, indexing="ij")
    assert np.array_equal(shared[0][1], imageops.sample(images[0], np.clip(x, 0, 31), np.clip(y, 0, 23)))


def test_tiles_leave_in_large_batches(spark):
    images = spark.createDataFrame([(k, 20, 30, bytes(np.random.default_rng(k).integers(0, 256, 1800).astype(np.uint8))) for k in range(3)], "image_id long, height int, width int, data binary")
    cut = imageops.cut_tiles(images, 16, 11)
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    got = {(r.image_id, r.tile_id): bytes(r.png) for r in cut.collect()}
    assert sorted(got) == [(k, t) for k in range(3) for t in range(1, 7)]
    img = np.random.default_rng(2).integers(0, 256, 1800).astype(np.uint8).reshape(20, 30, 3)[::-1]
    assert got[2, 5] == imageops.to_png(imageops.tile(img, 11, 11, 16)[::-1])


def test_unions_of_many(spark):
    """Whole batches against one row at a time: stars, boxes that share sides or corners, odd rows."""
    r = np.random.default_rng(11)
    turn = lambda m: np.sort(r.random(m))[:, None] * 2 * np.pi
    star = lambda m: np.concatenate([np.cos(a := turn(m)), np.sin(a)], 1) * r.uniform(0.3, 1.5, (m, 1)) + r.uniform(0, 3, 2)
    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    rows = [[star(r.integers(3, 12)).tolist() for _ in range(r.integers(0, 5))] for _ in range(150)]
    rows += [[box(*r.integers(0, 6, 2), *r.integers(1, 4, 2)).tolist() for _ in range(r.integers(1, 6))] for _ in range(150)]
    rows += [[r.integers(0, 4, (r.integers(3, 9), 2)).astype(float).tolist() for _ in range(2)] for _ in range(100)]
    rows += [None, [], [[]], [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]], [[[0.0, k] for k in (0.0, 1.0, 2.0, 3.0)]], [box(0, 0, 1, 1).tolist(), box(1, 1, 1, 1).tolist()]]
    rows = [rows[k] for k in r.permutation(len(rows))]
    want = [features.boundary(features.slabs([np.array(g) for g in row or [] if len(g) >= 4])) for row in rows]
    column = pa.array(rows, pa.list_(pa.list_(pa.list_(pa.float64()))))
    assert features.unions(column).to_pylist() == want
    assert features.unions(column.slice(7, 200)).to_pylist() == want[7:207]


def test_unions_are_made_once(spark):
    text = catalog.QUERIES["polygon_union"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
