"""Rows of an image that are dealt out once: what later steps write and move, and that results stay the same."""

import random

import pytest
from pyspark.sql import functions as F

from boxlake.operators import assignment, matching, metrics, stats, steps, suppression, tiling
from boxlake.plans import catalogue
from boxlake.plans.fixtures import fixtures
from boxlake.sources import shared, writers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def tables(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield fixtures(spark, sf_dir, "fx_det", "fx_gt", "fx_images")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _recorded(monkeypatch, module, name="written"):
    seen, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **k: seen.append((df, k)) or real(df, *a, **k))
    return seen


def test_cells_meet_where_images_are(tables):
    det, gt, _ = tables
    found = matching.match_predictions(det, gt, cell=256)
    assert not any("cell_x" in line for line in _plan(found).splitlines() if "Exchange" in line)
    assert _rows(found) == _rows(matching.match_predictions(shared.written(det), shared.written(gt), cell=256))


def test_tiles_are_not_dealt_out_again(spark, sf_dir, tables):
    _, gt, images = tables
    tiles = tiling.tiles_with_annotations(images, gt)
    assert "Exchange" not in _plan(tiles) and "Exchange" not in _plan(tiling.distinct_tiles(tiles))
    assert _rows(tiles) == _rows(tiling.tiles_with_annotations(shared.written(images), shared.written(gt)))


def test_distinct_tiles_of_a_file_that_images_share(spark):
    rows = [(1, "a", 0, 0, 5, 5), (1, "a", 0, 0, 5, 5), (2, "a", 0, 0, 5, 5), (2, "a", 5, 0, 9, 5), (3, "b", 0, 0, 5, 5), (4, None, 0, 0, 5, 5), (5, None, 0, 0, 5, 5)]
    tiles = spark.createDataFrame(rows, "image_id int, file_name string, x0 int, y0 int, x1 int, y1 int")
    found = tiling.distinct_tiles(tiles).select("file_name", "x0").collect()
    assert sorted(map(str, found)) == sorted(map(str, tiles.select("file_name", "x0").distinct().collect()))


def test_sampled_tiles_are_written_once(monkeypatch, tables):
    _, gt, images = tables
    tiles = tiling.tiles_with_annotations(images, gt)
    seen = _recorded(monkeypatch, tiling)
    assert tiling.sample_tiles(tiles, 0.5).count() and not seen


def test_few_boxes_are_one_patch(spark):
    rng = random.Random(3)
    boxes = [(1 if k < 200 else 2 + k % 20, k, float(rng.random()), x := rng.randrange(2000), y := rng.randrange(2000), x + 90, y + 80) for k in range(400)]
    det = spark.createDataFrame(boxes, "image_id long, det_id long, score double, x_min int, y_min int, x_max int, y_max int")
    patch = suppression._patched(det, 64)
    assert {r.image_id for r in patch.filter("patch IS NOT NULL").collect()} == {1}
    assert _rows(suppression.lsnms(det, 0.2, cell=64)) == _rows(suppression.nms(det, 0.2))


def test_rotated_pairs_in_batches(spark):
    rng = random.Random(5)
    box = lambda k: (k % 4, k, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(-3, 3))
    schema = "image_id long, {} long, cx double, cy double, w double, h double, angle double"
    d = spark.createDataFrame([box(k) for k in range(60)] + [(0, 60, 5.0, 5.0, 4.0, 4.0, 0.0), (0, 61, 5.0, 5.0, 0.0, 0.0, 0.0)], schema.format("det_id"))
    g = spark.createDataFrame([box(k) for k in range(60)] + [(0, 60, 5.0, 5.0, 4.0, 4.0, 0.0), (0, 61, 6.0, 5.0, 4.0, 4.0, 0.0)], schema.format("annotation_id"))
    found = suppression.rotated_pairs(d, g)
    assert "MapInArrow" in _plan(found)
    corners = lambda df, name: suppression._cornered(df).withColumnRenamed("corners", name)
    want = corners(d, "a").select("image_id", "det_id", "a").join(corners(g, "b").select("image_id", "annotation_id", "b"), "image_id").withColumn("want", suppression.rotated_iou(F.col("a"), F.col("b")))
    both = want.join(found, ["image_id", "det_id", "annotation_id"], "left").collect()
    assert len(both) > 900 and all(abs(r.want - (r.value or 0.0)) < 1e-9 for r in both)
    assert {r.value for r in both if (r.det_id, r.annotation_id) == (60, 60)} == {1.0}


def test_described_values_are_counted_first(spark, monkeypatch):
    seen = _recorded(monkeypatch, stats, "in_ranges")
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("a"))
    row = stats.describe(df, ["a"]).first()
    assert seen[0][0].count() == 7
    want = df.agg(F.count("a"), F.avg("a"), F.stddev_samp("a"), F.min("a"), F.percentile("a", 0.25), F.percentile("a", 0.5), F.percentile("a", 0.75), F.max("a")).first()
    assert tuple(row)[1:] == pytest.approx(tuple(want))


@pytest.mark.parametrize("name, module", [("point_matches", assignment), ("point_metrics", assignment), ("parameter_sweep", metrics)])
def test_pairs_are_counted_where_they_are(spark, sf_dir, monkeypatch, name, module):
    seen = _recorded(monkeypatch, module)
    assert catalogue.queries()[name](spark, sf_dir).count()
    assert any(k.get("together") for _, k in seen)


@pytest.mark.parametrize("name", ["hard_negative_paths", "hard_negative_manifest"])
def test_a_rounds_detections_stay_by_image(spark, sf_dir, monkeypatch, name):
    seen = _recorded(monkeypatch, steps, "written_in_buckets")
    assert catalogue.queries()[name](spark, sf_dir).count()
    assert [df.columns[:1] for df, _ in seen] == [["image_id"]]


def test_task_export_is_compressed(spark, sf_dir, tmp_path, tables):
    from boxlake.plans import source_queries

    (names,) = fixtures(spark, sf_dir, "fx_label_map")
    assert source_queries._tasks(spark, f"{tmp_path}/t", tables[0], names).count() == tables[0].count()
    assert list(tmp_path.glob("t/*.json.gz")) and not list(tmp_path.glob("t/*.json"))


def test_parts_of_a_document_are_compressed(spark, tmp_path, monkeypatch):
    parts, real = [], writers.join_files

    def join(session, folder, path):
        parts.extend(p.name for p in tmp_path.glob("_parts/part-*"))
        real(session, folder, path)

    monkeypatch.setattr(writers, "join_files", join)
    images = spark.createDataFrame([(1, 4, 4, "a.jpg")], "id long, width int, height int, file_name string")
    boxes = spark.createDataFrame([(7, 1, 0, [0.0, 0.0, 1.0, 1.0], [[0.0]], 1.0, 0)], "id long, image_id long, category_id int, bbox array<double>, segmentation array<array<double>>, area double, iscrowd int")
    writers.write_coco(images, boxes, spark.createDataFrame([(0, "x")], "id int, name string"), str(tmp_path), single=True)
    assert parts and all(p.endswith(".gz") for p in parts)
    assert '"file_name":"a.jpg"' in (tmp_path / "coco.json").read_text()


def test_numbering_moves_rows_once(spark):
    from boxlake.operators import ordered

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    placed = ordered.with_place(spark.range(50).select((-F.col("id")).alias("id")), ["id"], "place")
    assert "SortMergeJoin" not in _plan(placed) and [r.place for r in placed.orderBy("id").collect()] == list(range(50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
