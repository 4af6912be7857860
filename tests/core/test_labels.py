"""Tile labels, numbers as text, grids, the command line and the entry."""

import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.functions import scalars as sc
from tessella.operators import annotate, features, stats, tiling
from tessella.operators import imageops as im
from tessella.sinks import writers
from tessella.sources import listing

RASTER = [(1, 1.0, 1.0, 0.0, 0.0, 100.0, 100.0)]
R_SCHEMA = "raster_id long, cell_x double, cell_y double, xmin double, ymin double, xmax double, ymax double"
S_SCHEMA = f"raster_id long, shape_no long, class_id int, rings {annotate.RINGS}"


def test_fixed_equals_python(spark):
    r = random.Random(2)
    values = [k / 128 for k in range(129)] + [r.random() for _ in range(4000)] + [(2 * k + 1) / 2e6 for k in r.sample(range(10**6), 4000)] + [0.0, 1.0, 1e-7, 5e-7, 123.4567895, 1e5 + 0.0000005, -0.25]
    got = [x.t for x in spark.createDataFrame([(v,) for v in values], "v double").select(sc.fixed(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.6f}" for v in values]


def test_numbers_of_any_length(spark):
    names = ["t_00010", "t_" + "9" * 25, "x1" + "0" * 30, "a0", "b_1", "plain"]
    rows = spark.createDataFrame(list(enumerate(names)), "row_no long, name string")
    found = {r.alias: r.row_no for r in tiling.aliases(rows).collect()}
    assert found["t10"] == 0 and found["t_9"] == 0 and found["t" + "9" * 25] == 1 and found["t_" + "9" * 24 + "8"] == 1
    assert found["x" + "9" * 30] == 2 and found["a0"] == 3 and found["b0"] == 4 and "plain" in found


def test_box_tiles_equals_all_pairs(spark):
    r = random.Random(4)
    rasters = [(k, r.choice([0.5, 1.0]), 1.0, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.uniform(5, 400), y + r.uniform(5, 400)) for k in range(4)]
    boxes = [(r.randrange(4), n, x := r.uniform(-80, 450), y := r.uniform(-80, 450), x + r.uniform(0, 90), y + r.uniform(0, 90)) for n in range(150)] + [(0, 999, rasters[0][3] + 64, rasters[0][4], rasters[0][3] + 64, rasters[0][4])]
    a, b = spark.createDataFrame(rasters, R_SCHEMA), spark.createDataFrame(boxes, "raster_id long, n long, xmin double, ymin double, xmax double, ymax double")
    tiles = tiling.tile_grid(a, 64, 0.3).collect()
    want = sorted((t.raster_id, t.tile_id, x[1]) for t in tiles for x in boxes if x[0] == t.raster_id and x[2] <= t.xmax and t.xmin <= x[4] and x[3] <= t.ymax and t.ymin <= x[5])
    assert want and sorted((x.raster_id, x.tile_id, x.n) for x in tiling.box_tiles(a, b, 64, 0.3).collect()) == want


def labelled(spark, shapes, mode):
    rasters = spark.createDataFrame(RASTER, R_SCHEMA)
    lines = annotate.shape_lines(annotate.cut_shapes(spark.createDataFrame(shapes, S_SCHEMA), rasters, 100, 0.0), mode)
    return annotate.tile_labels(lines, tiling.tile_grid(rasters, 100, 0.0)).first().text


def test_modes_by_hand(spark):
    triangle = [(10.0, 10.0), (50.0, 10.0), (10.0, 90.0)]
    small, outside = [(80.0, 80.0), (90.0, 80.0), (90.0, 90.0)], [(90.0, 90.0), (130.0, 90.0), (130.0, 130.0), (90.0, 130.0)]
    shapes = [(1, 2, 1, [small, triangle]), (1, 1, 1, [outside]), (1, 3, 0, [[(200.0, 200.0), (210.0, 200.0), (210.0, 210.0)]])]
    assert labelled(spark, shapes, "detection") == "1 0.950000 0.050000 0.100000 0.100000\n1 0.500000 0.500000 0.800000 0.800000"
    # The largest ring wins over parts and holes; of the square only what lies in the tile, from the cut on.
    assert labelled(spark, shapes, "segmentation") == "1 0.900000 0.000000 0.900000 0.100000 1.000000 0.100000 1.000000 0.000000\n1 0.100000 0.900000 0.500000 0.900000 0.100000 0.100000"
    square = labelled(spark, [(1, 1, 4, [[(50.0, 20.0), (80.0, 50.0), (50.0, 80.0), (20.0, 50.0)]])], "obb").split()
    points = sorted((float(x), float(y)) for x, y in zip(square[1::2], square[2::2], strict=True))
    assert square[0] == "4" and np.allclose(points, [(0.2, 0.5), (0.5, 0.2), (0.5, 0.8), (0.8, 0.5)], atol=1e-6)
    flat = [(1, 1, 0, [[(0.0, 5.0), (100.0, 5.0), (50.0, 5.0)]])]
    assert [labelled(spark, flat, m) for m in ("detection", "segmentation", "obb")] == ["", "", ""]


def test_tiles_anywhere_equal_the_lattice(spark):
    r = random.Random(6)
    ring = lambda x, y: [(x, y), (x + r.uniform(5, 60), y), (x + r.uniform(5, 60), y + r.uniform(5, 60))]
    shapes = spark.createDataFrame([(1, k, k % 3, [ring(r.uniform(-20, 110), r.uniform(-20, 110))]) for k in range(60)], S_SCHEMA)
    rasters = spark.createDataFrame(RASTER, R_SCHEMA)
    tiles = tiling.tile_grid(rasters, 30, 0.2)
    a = annotate.tile_labels(annotate.shape_lines(annotate.cut_shapes(shapes, rasters, 30, 0.2), "segmentation"), tiles).collect()
    b = annotate.tile_labels(annotate.shape_lines(annotate.cut_to_tiles(shapes.drop("raster_id"), tiles), "segmentation"), tiles).collect()
    assert sorted(a) == sorted(b) and any("\n" in x.text for x in a)


def test_grid_rows(spark):
    g = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("a", 3, 3.0), (None, 4, 4.0), ("", 5, 5.0), ("a", 6, None)], "name string, row_no long, xmin double")
    assert sorted((r.name, r.row_no, r.xmin) for r in tiling.load_grid(g).collect()) == [("a", 1, 3.0), ("b", 2, 2.0)]


def test_mask_modes(spark):
    p = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(9.0, 9.0), (9.5, 9.0), (9.0, 9.5)]]
    d = spark.createDataFrame([(1, p, 0.5, "c", "o", 1.0, 1.0, 0.0, 9.0, 0.0, 9.0, None)], "det_id long, polygons array<array<struct<x:double,y:double>>>, confidence double, class string, source_img string, pixel_w double, pixel_h double, xmin double, xmax double, ymin double, ymax double, bbox_xyxy array<double>")
    joined = features.masks(d, "union").collect()
    assert len(joined) == 1 and len(joined[0].geometry) == 1 and len(joined[0].geometry[0]) == 9
    assert features.masks(d, "all").collect() == features.masks(d).collect() and features.masks(d).count() == 1
    assert set(features.select_outputs(d, "mask, point ,x", "union")) == {"mask", "point"}


def test_suppression_of_a_chain(spark):
    """Each box overlaps the next: of a chain by falling confidence every other one stays."""
    rows = [(1, k, "a", 1 - k / 100, [k * 4.0, 0.0, k * 4.0 + 10, 10.0]) for k in range(12)]
    got = {r.det_id for r in features.suppress(spark.createDataFrame(rows, "raster_id long, det_id long, class string, confidence double, bbox_xyxy array<double>")).collect()}
    assert got == set(range(0, 12, 2))


def test_report(spark):
    s = spark.createDataFrame([("train", 1, True, [0, 0, 3], False), ("train", 2, False, [], True), ("valid", 3, True, [], True)], "split string, sample_id long, has_label boolean, classes array<int>, is_background boolean")
    t = {r.split: r.text for r in stats.report_lines(s).collect()}
    assert t["train"] == "- train:\n  images: 2\n  label files: 1\n  missing label files: 1\n  empty annotations: 1\n  images with objects: 1\n  total objects: 3\n  class balance:\n    class 0: 2 (66.67%)\n    class 3: 1 (33.33%)"
    assert t["valid"].endswith("class balance: no objects") and t["test"] == "- test: not found"
    assert stats.warnings_of(32, 0.95, 0, 40, 200_000)[0] == ["Tile Size should be in range [64..2048].", "Overlap should be in range [0..0.9].", "Select at least one annotation layer."]
    assert stats.can_run(70, 20, 5, 1) == "Split sum must be 100." and stats.can_run(70, 20, 10, 1) is None and stats.warnings_of(64, 0, 1, 50, 1) == ([], [])


def test_summary_read_back(tmp_path):
    for s, kind, name in (("train", "images", "a.PNG"), ("train", "images", "b.gif"), ("valid", "labels", "a.txt"), ("test", "images", "c.tif")):
        (tmp_path / s / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / s / kind / name).write_bytes(b"")
    assert listing.read_summary(None, str(tmp_path)) == (2, 1)
    writers.write_text(str(tmp_path / "dataset_build_summary.json"), '{"total_images": 5, "total_labels": 9}')
    assert listing.read_summary(None, str(tmp_path)) == (5, 9)
    writers.write_text(str(tmp_path / "dataset_build_summary.json"), "{")
    assert listing.read_summary(None, str(tmp_path)) == (2, 1)


def test_commands(spark, tmp_path, capsys):
    y, x = np.mgrid[:60, :80]
    img = np.stack([x * 3, y * 4, x + y], 2).astype(np.uint8)
    ortho = tmp_path / "Products" / "Orthos" / "o.png"
    ortho.parent.mkdir(parents=True)
    ortho.write_bytes(im.to_png(img))
    ortho.with_suffix(".tif").write_bytes(b"")
    tiles, root = str(tmp_path / "tiles"), str(tmp_path / "data")
    assert cli.main(["tile", "--ortho-image", "/none.png", "--tiles-folder", tiles], spark) == 2
    assert cli.main(["tile", "--ortho-image", str(ortho), "--tiles-folder", tiles, "--tile-size", "40", "--overlap", "100"], spark) == 4
    assert cli.main(["tile", "--ortho-image", str(ortho), "--tiles-folder", tiles, "--tile-size", "40", "--overlap", "50"], spark) == 0
    made = sorted(Path(tiles, "Images").glob("*.png"))
    assert len(made) == 12 and listing.grid_path(tiles).endswith("Tile_Grid_Pixels.parquet")
    shapes = [("Roof", 1, [[(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0)]]), ("tree ", 2, [[(41.0, 21.0), (59.0, 21.0), (50.0, 39.0)]])]
    spark.createDataFrame(shapes, f"layer string, shape_no long, rings {annotate.RINGS}").write.parquet(str(tmp_path / "a"))
    build = lambda *more: cli.main(["build", "--tiles-folder", tiles, "--dataset-root", root, "--annotations", str(tmp_path / "a"), "--train", "70", "--val", "20", "--test", "10", *more], spark)
    assert build("--layers", "roof", "--tiles-folder", "/none") == 3 and build("--layers", " | ") == 4 and build("--layers", "water") == 5
    (tmp_path / "bare").mkdir()
    assert build("--layers", "roof", "--tiles-folder", str(tmp_path / "bare")) == 6
    assert build("--layers", "roof|Tree", "--dataset-type", "Segmentation") == 0
    summary = json.loads(Path(root, "dataset_build_summary.json").read_text())
    labels = sorted(Path(root).glob("*/labels/*.txt"))
    lines = [line for p in labels for line in p.read_text().splitlines()]
    assert summary["total_images"] == len(labels) == len(list(Path(root).glob("*/images/*.png"))) and summary["total_labels"] == len(lines) > 3
    assert {line.split()[0] for line in lines} == {"0", "1"}
    assert cli.main(["augment", "--dataset-root", "/none"], spark) == 2 and cli.main(["augment", "--dataset-root", root], spark) == 1
    Path(root, "augmentation_config.yaml").write_text("seed: 3\ngeometry:\n  flip_horizontal: true\ncolor:\n  hue: {value: 0.1, value_min: 0.05, value_max: 0.1, prob: 1, enabled: true}\n")
    before = len(list(Path(root).glob("train/images/*")))
    assert cli.main(["augment", "--dataset-root", root], spark) == 0
    told = json.loads(Path(root, "augmentation_run_summary.json").read_text())
    assert told["total_created"] == 2 * before and len(list(Path(root).glob("train/images/*"))) == 3 * before == len(list(Path(root).glob("train/labels/*")))
    assert cli.main(["augment", "--preview-image", str(made[0]), "--preview-output", str(tmp_path / "p.png"), "--config", str(Path(root, "augmentation_config.yaml")), "--preview-op", "hue", "--preview-summary", str(tmp_path / "p.json")], spark) == 0
    assert json.loads((tmp_path / "p.json").read_text())["applied_steps"] == ["hue"] and (tmp_path / "p.png").exists()
    found = [{"class": "c", "confidence": c, "bbox_xyxy": [1, 1, 9 + c, 9], "mask_polygons_px": [[[1, 1], [9, 1], [9, 9], [1, 9]]]} for c in (0.9, 0.8, 0.1)]
    (tmp_path / "d.json").write_text(json.dumps(found))
    capsys.readouterr()
    assert cli.main(["detect", "--tiles-dir", tiles, "--detections", str(tmp_path / "d.json"), "--raster-width", "80", "--raster-height", "60"], spark) == 0
    out = Path(capsys.readouterr().out.strip().removeprefix("EXPERIMENT_DIR="))
    assert {p.name for p in out.iterdir()} == {"Detected_Points", "Detected_BBoxes", "Detected_Masks"} and spark.read.parquet(str(out / "Detected_BBoxes")).count() == 1
    assert spark.read.parquet(str(out / "Detected_Points")).first().source_img == "o"


@pytest.mark.parametrize("left", ["nothing", "empty folder"])
def test_entry_without_the_text_package(tmp_path, left):
    here = Path(__file__).resolve().parents[2]
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left != "nothing":
        (tmp_path / "tessella" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tile_grid' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')]; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
