"""Hand-worked cases and properties of the operators."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.functions import boxes, geo, paths
from boxlake.operators import checks, labels, matching, metrics, sampling, selection, stats, steps, suppression, tiling
from boxlake.operators import conversions as cv


def gts(spark, *rows):
    return spark.createDataFrame([(k, i, f"i{i}.jpg", 1000, 1000, c, *b) for k, i, c, b in rows], schemas.GROUND_TRUTH)


def dets(spark, *rows):
    return spark.createDataFrame([(k, i, f"i{i}.jpg", 1000, 1000, c, *b, float(s)) for k, i, c, b, s in rows], schemas.DETECTIONS)


A, B, FAR = (0, 0, 100, 100), (10, 0, 110, 100), (500, 500, 600, 600)


def test_equal_boxes_have_ciou_1(spark):
    row = matching.match_predictions(dets(spark, (1, 1, 0, A, 0.9)), gts(spark, (5, 1, 0, A))).first()
    assert row.best_ciou == pytest.approx(1) and row.annotation_id == 5 and (row.tp, row.fp) == (1, 0)


def test_two_predictions_may_claim_one_truth_but_not_one_to_one(spark):
    d, g = dets(spark, (1, 1, 0, A, 0.9), (2, 1, 1, B, 0.8)), gts(spark, (5, 1, 0, A))
    assert [r.tp for r in matching.match_predictions(d, g).collect()] == [1, 1]
    cells = {(r.gt_class, r.pred_class): r.n for r in matching.confusion_one_to_one(d, g, 2).collect()}
    assert cells == {(0, 0): 1, (2, 1): 1}


def test_background_images_and_scopes(spark):
    d, g = dets(spark, (1, 1, 0, A, 0.9), (2, 1, 0, FAR, 0.8)), gts(spark, (5, 2, 0, A))
    assert [r.fp for r in matching.match_predictions(d, g).collect()] == [2, 2]
    assert [r.fp for r in matching.match_predictions(d, g, fp_mode="row").collect()] == [1, 1]
    assert matching.missed_ground_truth(d, g).count() == 0
    assert matching.missed_ground_truth(d, g, scope="all").count() == 1
    with pytest.raises(ValueError):
        matching.match_predictions(d, g, fp_mode="other")


def test_empty_tables(spark):
    d, g = dets(spark, (1, 1, 0, A, 0.9)).limit(0), gts(spark, (5, 1, 0, A))
    assert matching.match_predictions(d, g).count() == 0
    assert selection.image_table(d, g).count() == 0
    assert suppression.nms(d).count() == 0


def test_nms_keeps_what_only_a_dropped_box_overlaps(spark):
    c = (60, 0, 160, 100)
    d = dets(spark, (1, 1, 0, A, 0.9), (2, 1, 0, (30, 0, 130, 100), 0.8), (3, 1, 0, c, 0.7))
    ids = lambda x: sorted(r.det_id for r in x.collect())
    assert ids(suppression.nms(d, 0.5)) == [1, 3]
    assert ids(suppression.nms(d, 0.5, crowded=1)) == [1, 3]
    assert ids(suppression.lsnms(d, 0.5, cell=64)) == [1, 3]
    assert ids(suppression.nms(suppression.nms(d, 0.5), 0.5)) == [1, 3]
    m = suppression.merged(d, 0.5, measure="iou").orderBy("det_id").collect()
    assert [(r.det_id, r.x_min, r.x_max) for r in m] == [(1, 0, 130), (3, 60, 160)]


def test_rotated_overlap(spark):
    square = boxes.rotated_corners(*(F.lit(float(v)) for v in (0, 0, 2, 2, 0)))
    turned = boxes.rotated_corners(*(F.lit(float(v)) for v in (0, 0, 2, 2, math.pi / 4)))
    apart = boxes.rotated_corners(*(F.lit(float(v)) for v in (9, 9, 2, 2, 0)))
    row = spark.range(1).select(suppression.rotated_iou(square, square).alias("a"), suppression.rotated_iou(square, turned).alias("b"), suppression.rotated_iou(square, apart).alias("c")).first()
    eight = 8 * (math.sqrt(2) - 1)
    assert row.a == pytest.approx(1) and row.b == pytest.approx(eight / (8 - eight)) and row.c == 0
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0, 0.0, 0.9), (1, 2, 0.1, 0.0, 2.0, 2.0, 0.1, 0.8), (1, 3, 9.0, 9.0, 2.0, 2.0, 0.0, 0.1)], "image_id bigint, det_id bigint, cx double, cy double, w double, h double, angle double, score double")
    assert sorted(r.det_id for r in suppression.rotated_nms(d).collect()) == [1, 3]


def test_tile_edges(spark):
    images = spark.createDataFrame([(1, "a/images/s.jpg", "a/images", 600, 500, "train"), (2, "a/images/l.jpg", "a/images", 1300, 640, "val")], schemas.IMAGES)
    small, *large = tiling.tile_grid(images).orderBy("image_id", "x0").collect()
    assert (small.x0, small.y0, small.x1, small.y1) == (0, 0, 600, 500)
    assert [(t.x0, t.x1) for t in large] == [(0, 640), (512, 1152), (660, 1300)]
    box = gts(spark, (1, 2, 0, (620, 0, 720, 100))).withColumns({"width": F.lit(1300), "height": F.lit(640)})
    assert {r.ix for r in tiling.assign_boxes_to_tiles(box, min_area_ratio=0.2).collect()} == {0, 1, 2}
    assert {r.ix for r in tiling.assign_boxes_to_tiles(box, min_area_ratio=0.6).collect()} == {1, 2}, "exactly at the ratio counts"
    with pytest.raises(ValueError):
        tiling.tile_grid(images, 0)
    with pytest.raises(ValueError):
        tiling.sample_tiles(images, save_all=True, only_empty=True)


def test_entropy_of_zero_and_quality(spark):
    d = dets(spark, (1, 1, 0, A, 0.0), (2, 1, 0, B, 0.5))
    assert selection.image_uncertainty(d).first().uncertainty == pytest.approx(0.5 * math.log(2))
    assert selection.image_uncertainty(d, "1-p").first().uncertainty == pytest.approx(0.75)
    with pytest.raises(ValueError):
        selection.uncertainty("other")


def test_image_ap_by_hand(spark):
    g = gts(spark, (5, 1, 0, A), (6, 1, 0, FAR))
    d = dets(spark, (1, 1, 0, A, 0.9), (2, 1, 0, (300, 300, 400, 400), 0.8), (3, 1, 0, FAR, 0.7))
    row = metrics.image_ap(d, g).first()
    assert row.map50 == pytest.approx((51 * 1 + 50 * 2 / 3) / 101)
    assert metrics.image_ap(dets(spark, (1, 9, 0, A, 0.9)), g).first().map50 == -1


@pytest.mark.parametrize("crowded", [None, 0])
def test_a_mean_at_the_threshold_is_not_failed(spark, crowded):
    """map75 is 0.3: precision summed from the last detection on came to a bit less."""
    spot = lambda c, k: (200 * k, 200 * c, 200 * k + 100, 200 * c + 100)
    truth = [(10 * c + k, 1, c, spot(c, k)) for c, n in ((0, 5), (1, 6)) for k in range(n)]
    hits = {0: (0, 0, 1), 1: (0, 1, 1, 1, 1)}
    found = [(10 * c + k, 1, c, spot(c, k) if hit else (5000, 5000, 5100, 5100), 0.9 - k / 100) for c, row in hits.items() for k, hit in enumerate(row)]
    for d in (dets(spark, *found), dets(spark, *found[::-1])):
        row = selection.failed(metrics.image_ap(d, gts(spark, *truth), crowded=crowded)).first()
        assert row.map75 == pytest.approx(0.3) and not row.failed


def test_hard_samples_parity_leaves_gaps(spark):
    g = gts(spark, (5, 1, 0, A))
    d = dets(spark, (1, 1, 0, FAR, 0.9))
    table = selection.image_table(d, g)
    assert selection.hard_samples(table).first().uncertainty is not None
    assert selection.hard_samples(table, parity=True).first().uncertainty is None
    assert selection.match_rows(d, g).count() == 2
    paths_, manifest = selection.training_subset(selection.hard_samples(table), spark.createDataFrame([("train", "x"), ("val", "y")], "split string, dir string"))
    assert paths_.count() == 1 and {(r.split, r.dir) for r in manifest.collect()} == {("val", "y"), ("train", "i1.jpg")}


def test_round_trips(spark):
    yolo = spark.createDataFrame([(1, 1, "a.jpg", 0, 0.5, 0.4, 0.2, 0.1)], schemas.YOLO)
    assert [round(v, 9) for v in cv.obb_to_yolo(cv.yolo_to_obb(yolo)).select("x", "y", "w", "h").first()] == [0.5, 0.4, 0.2, 0.1]
    box = gts(spark, (1, 1, 0, (3, 5, 70, 90)))
    back = cv.percent_result_to_box(cv.percent_columns(box).drop("x_min", "y_min", "x_max", "y_max"))
    assert [round(v, 9) for v in back.select("x_min", "y_min", "x_max", "y_max").first()] == [3, 5, 70, 90]
    moved = box.withColumns({"x0": F.lit(2), "y0": F.lit(4)})
    assert cv.tile_to_image_coords(cv.image_to_tile_coords(moved)).select("x_min", "y_max").first() == (3, 90)


def test_expanding_is_chained_unless_symmetric(spark):
    box = gts(spark, (1, 1, 0, (10, 10, 110, 110)))
    assert tuple(cv.expand_box(box, 2.0).select("x1", "x2").first()) == (0, 165)
    assert tuple(cv.expand_box(box, 2.0, "symmetric").select("x1", "x2").first()) == (0, 160)
    with pytest.raises(ValueError):
        cv.expand_box(box, 0.5)


def test_polygons(spark):
    p = spark.createDataFrame([(1, 1, 100, 200, [(-3.5, 1.9), (10.0, 5.0), (4.0, 20.7)], 3)], schemas.POLYGONS + ", pixel_value int")
    r = cv.polygon_to_bbox(p).first()
    assert (r.x_min, r.y_min, r.x_max, r.y_max, r.x, r.bbox_w) == (0, 1, 10, 20, 3.25, 10)
    assert cv.polygon_to_seg_row(p).first().value == "2 -0.035 0.0095 0.1 0.025 0.04 0.1035"
    assert cv.polygon_to_seg_row(p, n_classes=2).count() == 0
    assert cv.polygon_to_oriented_box(p).count() == 0


def test_utm_known_place_and_centre(spark):
    df = spark.createDataFrame([(43.642567, -79.387139, 4000, 3000, 2.6), (-24.5, 31.25, 4000, 3000, None)], "lat double, lon double, exif_width int, exif_height int, gsd_cm double")
    east, north = geo.to_utm(F.col("lat"), F.col("lon"), geo.utm_zone(F.col("lon")))
    row = df.select(geo.utm_zone(F.col("lon")).alias("z"), east.alias("e"), north.alias("n")).first()
    assert row.z == 17 and row.e == pytest.approx(630084, abs=1.5) and row.n == pytest.approx(4833438, abs=1.5)
    for r in geo.pixel_to_latlon(df, F.lit(2000.0), F.lit(1500.0)).collect():
        assert (r.px_lat, r.px_lon) == (pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lon, abs=1e-8))


def test_positions_of_images_without_metadata(spark):
    d = dets(spark, (1, 1, 0, A, 0.9))
    meta = spark.createDataFrame([], schemas.IMAGE_META)
    assert geo.geotag_detections(d, meta).first().px_lat is None


def test_names(spark):
    df = spark.createDataFrame([("DJI_1_0009_0_48_0_1271_640_1911.jpg",), ("plain.jpg",)], "name string")
    a, b = df.select(*(c.alias(k) for k, c in paths.parse_tile_name(F.col("name")).items())).collect()
    assert tuple(a) == (0, 1271, 640, 1911, "DJI_1_0009_0.jpg") and tuple(b) == (None,) * 5
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.decoded_name(F.lit("x%2Fa+b%20c.jpg"))) == "a+b c.jpg"
    assert one(paths.posix_tail(F.lit("C:\\a\\b\\c.jpg"))) == "b/c.jpg"
    assert paths.tagged_run_name("run", conf=0.1, iou=0.5) == "run#conf0.1#iou0.5"
    with pytest.raises(Exception, match="no images"):
        paths.common_upload_dir(spark.createDataFrame([], "path string")).collect()


def test_labels_and_checks(spark):
    m = spark.createDataFrame([(0, "a"), (3, "b"), (7, "c")], schemas.LABEL_MAP)
    assert [(r.category_name, r.new_id) for r in labels.dense_label_map(m, discard=["a"]).collect()] == [("b", 0), ("c", 1)]
    with pytest.raises(ValueError):
        labels.filter_labels(m, ["a"], ["a"])
    for bad in ({"tile": 0}, {"ratio": -1}, {"factor": 0.5}, {"overwrite": True, "load_cached": True}, {"save_all": True, "only_empty": True}):
        with pytest.raises(ValueError):
            checks.check_parameters(**bad)
    checks.check_parameters(tile=640, ratio=0, factor=1)
    lines = spark.createDataFrame([("yolo",), ("yolo-obb",)], "label_format string")
    assert {r.uniform for r in checks.label_format_counts(lines).collect()} == {False}
    with pytest.raises(Exception, match="one label format"):
        checks.require_uniform(lines).collect()
    tasks = spark.range(5).withColumnRenamed("id", "task_id")
    assert labels.first_tasks(tasks, 2).count() == 2 and labels.first_tasks(tasks, 2, True).count() == 3 and labels.first_tasks(tasks, 0).count() == 5


def test_samples_nest_and_have_their_size(spark):
    images = spark.createDataFrame([(i, f"d/images/{i}.jpg", "d/images", 10, 10, "train") for i in range(300)], schemas.IMAGES)
    boxed = images.filter("image_id < 40")
    names = lambda df: {r.file_name for r in df.collect()}
    small, large = sampling.sample_empties(images, boxed, frac=0.1), sampling.sample_empties(images, boxed, frac=0.5)
    assert len(names(small)) == 26 and names(small) < names(large) and len(names(large)) == 130
    assert sampling.sample_empties(images, boxed, ratio=99.0).count() == 260
    assert sampling.sample_pos_neg(images, boxed, 0.5).count() == 60
    assert sampling.sample_pos_neg(images.limit(0), boxed, 0.5).count() == 0


def test_point_radius_and_skew(spark):
    near = (12, 0, 112, 100)
    d, g = dets(spark, (1, 1, 0, near, 0.9), (2, 1, 0, A, 0.8)), gts(spark, (5, 1, 0, A))
    row = metrics.point_metrics(d, g).first()
    assert (row.tp, row.fp, row.fn, row.mae) == (1, 1, 0, 1)
    crowd = spark.range(3000).select(F.col("id").alias("det_id"), F.lit(1).cast("bigint").alias("image_id"), F.lit("i").alias("file_name"), F.lit(99999).alias("width"), F.lit(99999).alias("height"), F.lit(0).alias("category_id"), *((F.col("id") * 20 % 60000 + k).cast("int").alias(c) for k, c in ((0, "x_min"), (0, "y_min"), (15, "x_max"), (15, "y_max"))), F.lit(0.5).alias("score"))
    truth = crowd.drop("score").withColumnRenamed("det_id", "annotation_id")
    assert matching.match_predictions(crowd, truth, cell=64).agg(F.sum("tp")).first()[0] == 3000


def test_scoring_and_pipeline(spark):
    images = spark.createDataFrame([(1, "i1.jpg")], "image_id bigint, file_name string")

    def load():
        return lambda part: pd.DataFrame({"image_id": part["image_id"], "file_name": part["file_name"], "x_min": 0.0, "y_min": 0.0, "x_max": 10.0, "y_max": 10.0, "score": 0.9, "category_id": 1})

    context = steps.Pipeline([lambda c: {"boxes": steps.score_images(c["images"], load)}, lambda c: {"n": c["boxes"].count()}]).run({"images": images})
    assert context["n"] == 1
    steps.register_tile_function(spark, "tile_corners")
    assert spark.sql("SELECT * FROM tile_corners(1300, 640, 640, 0.2D)").count() == 3


def test_nested_objects_of_empty_images(spark):
    images = spark.createDataFrame([(1, "a.jpg", "d", 50, 60, "train"), (2, "b.jpg", "d", 50, 60, "train")], schemas.IMAGES)
    rows = {r.file_name: r for r in stats.image_objects(images, gts(spark, (1, 1, 3, A))).collect()}
    assert rows["a.jpg"].width == 50 and rows["a.jpg"].objects.categories == [3]
    assert rows["b.jpg"].width == 2000 and rows["b.jpg"].objects.bbox == []
    assert steps.classification_report(dets(spark, (1, 1, 0, A, 0.9)), gts(spark, (5, 1, 0, A)), 2).first().f1 == 1.0


def test_a_task_counts_once_for_the_retrain_trigger(spark, tmp_path):
    from boxlake.streaming import jobs

    schema = "project_id int, task_id bigint"
    parts = [[(1, 1), (1, 2), (2, 1)], [(1, 2), (1, 1), (1, 3), (2, None)], [(1, 1), (1, 3), (1, 2)], [(1, 4), (1, 5), (1, 5), (2, 7)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.retrain_trigger(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 1, 2), (1, 2, 4), (2, 1, 2)]


def test_order_over_ranges(spark):
    from boxlake.operators import ordered

    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, w int").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(ordered.with_place(df, ["g", "v"], "id").collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(400)) and [key(r) for r in got] == sorted(map(key, rows))
    known = df.filter("g IS NOT NULL").dropDuplicates(["g", "v"])
    sums = ordered.running(ordered.in_ranges(known, "g", "v"), ["g"], {"s": ("sum", "w"), "m": ("max", "w")}).collect()
    for r in sums:
        upto = [x.w for x in sums if x.g == r.g and x.v <= r.v]
        assert (r.s, r.m) == (sum(upto), max(upto))
    assert ordered.with_place(df.limit(0), ["g"], "id").count() == 0


def test_components_of_a_chain(spark):
    from boxlake.operators.components import components

    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (103, 103), (200, 200)]
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert got == [(i, 1) for i in range(2, 61)] + [(101, 100), (103, 100)]


def test_staged_subsets_nest_in_each_folder(spark):
    images = spark.createDataFrame([(i, f"{i}.jpg", f"d{i % 2}", 10, 10, "train") for i in range(400)], schemas.IMAGES)
    stages = sampling.staged_subsets(images, images.filter("image_id < 40"), (0.0, 0.5, 99.0)).collect()
    at = {r: {x.file_name for x in stages if x.ratio == r} for r in (0.0, 0.5, 99.0)}
    assert [len(at[r]) for r in at] == [40, 60, 400] and at[0.0] < at[0.5] < at[99.0]


def test_names_are_cut_as_by_patterns(spark):
    names = ["a/b.c/d_0_1_2_3_4.jpg", "d\\e_x_y_7_10_20_30_40.png", "_0_1_2_3_4.jpg", "a_0_1_2_3.jpg", "a_0_1_2_3_x.jpg", "a__1_2_3_4", "a.b/", "", ".x", "a.", "a.b.", "x/.y.z", "no", None, "é_1_2_3_4_5.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    stem = F.regexp_replace(F.regexp_extract("name", r"[^/\\]+$", 0), r"\.[^.]+$", "")
    part = lambda k: F.nullif(F.regexp_extract(stem, r"^(.*)_[^_]*_(\d+)_(\d+)_(\d+)_(\d+)$", k), F.lit(""))
    want = [stem, *(part(k).cast("int") for k in range(2, 6)), F.concat(part(1), F.lit(".jpg"))]
    got = df.select(*(c.alias(f"w{k}") for k, c in enumerate(want)), paths.stem(F.col("name")).alias("stem"), *(c.alias(n) for n, c in paths.parse_tile_name(F.col("name")).items()))
    assert all(tuple(r)[:6] == tuple(r)[6:] for r in got.collect())
    plan = df.select(*(c.alias(n) for n, c in paths.parse_tile_name(F.col("name")).items()))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # patterns for each part took most of the time


@pytest.mark.parametrize("n", [12, 90])
def test_crowded_suppression_reads_runs_of_images(spark, n):
    rng = random.Random(n)
    rows = [(i, f"i{i}", 0, i * 1000 + k, rng.choice([0.2, 0.5, 0.9]), *(float(v) for v in (x, y, x + rng.randint(0, 60), y + rng.randint(0, 60)))) for i in range(5) for k in range(n) for x, y in [(rng.randint(0, 120), rng.randint(0, 120))]]
    d = spark.createDataFrame(rows, "image_id bigint, file_name string, category_id int, det_id bigint, score double, x_min double, y_min double, x_max double, y_max double")
    crowded = suppression.nms(d, 0.3, crowded=3)
    assert {r.det_id for r in crowded.collect()} == {r.det_id for r in suppression.nms(d, 0.3).collect()}
    assert "FlatMapGroups" not in crowded._jdf.queryExecution().optimizedPlan().toString()  # a data frame for each image took most of the time


def test_average_precision_takes_no_written_pairs(spark, monkeypatch):
    """Image tables and match rows write pairs of one measure; average precision deals boxes out by itself."""
    row = (1, "a", 0, 1, 0.0, 0.0, 10.0, 10.0)
    g = spark.createDataFrame([row], "image_id bigint, file_name string, category_id int, annotation_id bigint, x_min double, y_min double, x_max double, y_max double")
    d, seen, image_ap = g.withColumnRenamed("annotation_id", "det_id").withColumn("score", F.lit(0.9)), [], metrics.image_ap
    monkeypatch.setattr(metrics, "image_ap", lambda *a, near=None, **k: seen.append(near) or image_ap(*a, near=near, **k))
    assert selection.image_table(d, g).first().map50 == 1 and selection.match_rows(d, g).first().map75 == 1
    assert seen == [None, None]
