"""COCO documents in parts, summaries, order, checks, rounds of learning and streams on hand-made rows."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.operators import checks, conversions, labels, sampling, selection, stats, steps, suppression, tiling
from boxlake.operators.ordered import in_ranges
from boxlake.sources import readers, writers
from boxlake.sources.shared import written, written_in_buckets
from boxlake.streaming import jobs

IMAGES = "id bigint, width int, height int, file_name string"
ANNOTATIONS = "id bigint, image_id bigint, category_id int, bbox array<double>, segmentation array<array<double>>, area double, iscrowd int"


def coco_set(n):
    images = [(k, 10, 20, f"dir/ä {k}.jpg") for k in range(n)]
    annotations = [(k * 2 + j, k, j, [1.0, 2.0, 3.0, 4.0], [[1.0, 2.0, 3.0, 4.0]], 12.0, 0) for k in range(n) for j in range(k % 3)]
    return images, annotations, [(0, "roan"), (1, "nyala(m)")]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_one_coco_document_in_parts(spark, tmp_path, n):
    images, annotations, categories = coco_set(n)
    frames = spark.createDataFrame(images, IMAGES).repartition(5), spark.createDataFrame(annotations, ANNOTATIONS).repartition(5), spark.createDataFrame(categories, "id int, name string")
    path = str(tmp_path / "coco")
    writers.write_coco(*frames, path, single=True)
    doc = json.loads((tmp_path / "coco" / "coco.json").read_text())
    assert [tuple(x.values()) for x in doc["images"]] == images and [tuple(x.values()) for x in doc["annotations"]] == annotations
    assert [tuple(x.values()) for x in doc["categories"]] == categories and not (tmp_path / "coco" / "_parts").exists()
    for whole in (False, True):
        i, a, c = readers.read_coco(spark, path, whole)
        assert sorted(map(tuple, i.collect())) == images and sorted(map(tuple, a.collect())) == annotations and sorted(map(tuple, c.collect())) == categories


@pytest.mark.parametrize("indent", [None, 2])
def test_other_layouts_are_split_too(spark, tmp_path, indent):
    images, annotations, categories = coco_set(200)
    named = lambda rows, schema: [dict(zip((f.split()[0] for f in schema.split(", ")), r)) for r in rows]
    doc = {"categories": [{"id": k, "name": v, "supercategory": "x"} for k, v in categories], "info": {"description": "d", "url": "u"}, "licenses": [{"id": 1, "name": "CC", "url": "u"}], "annotations": named(annotations, ANNOTATIONS), "images": [x | {"license": 1} for x in named(images, IMAGES)]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        i, a, c = readers.read_coco(spark, str(tmp_path / "d.json"))
        assert a.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, i.collect())) == images and sorted(map(tuple, a.collect())) == annotations and sorted(map(tuple, c.collect())) == categories
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("item", [{"id": 1, "image_id": 2, "segmentation": {"counts": "x", "size": [1, 2]}}, {"id": 1, "file_name": "a{1}.jpg"}, {"id": 1, "file_name": "a}.jpg"}])
def test_items_with_braces_fail_the_split(spark, tmp_path, item):
    (tmp_path / "d.json").write_text(json.dumps({"images": [item], "annotations": [], "categories": []}))
    with pytest.raises(Exception, match="as a whole"):
        readers.read_coco(spark, str(tmp_path / "d.json"))[0].collect()


# summaries and order


def test_describe(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.5, rng.random() * 9]), k if k % 7 else None) for k in range(501)]
    df = spark.createDataFrame(rows, "a double, b int").repartition(4)
    want = {}
    for name, values in (("a", [r[0] for r in rows if r[0] is not None]), ("b", [float(r[1]) for r in rows if r[1] is not None])):
        q = statistics.quantiles(values, n=4, method="inclusive")
        want[name] = (len(values), statistics.mean(values), statistics.stdev(values), min(values), *q, max(values))
    got = {r["column"]: tuple(r)[1:] for r in stats.describe(df, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    near = {r["column"]: r.q50 for r in stats.describe(df, ["a", "b"], approximate=True).collect()}
    assert near["b"] == pytest.approx(want["b"][5], abs=2)
    assert {r.q10: r.q90 for r in stats.describe(spark.range(1).select(F.lit(5).alias("x")), ["x"], (0.1, 0.9)).collect()} == {5: 5}
    assert stats.describe(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        stats.describe(df, ["a"], (2.0,))


def test_order(spark, tmp_path):
    rows = [(f"f{k:03}", [0.5, None, 0.1, 0.9][k % 4]) for k in range(100)]
    df = spark.createDataFrame(rows, "file_name string, uncertainty double").repartition(7)
    for ascending in (False, True):
        sign = 1 if ascending else -1
        want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))]
        out = selection.in_order(df, ascending=ascending)
        assert [r.file_name for r in sorted(out.collect(), key=lambda r: r.place)] == want
        assert [r.place for r in out.collect()] == list(range(100))


# parameters and conversions


def test_operators_check_their_parameters(spark):
    images = spark.createDataFrame([], "image_id bigint, file_name string, image_dir string, width int, height int")
    gts = spark.createDataFrame([], "annotation_id bigint, image_id bigint, category_id int, width int, height int, x_min int, y_min int, x_max int, y_max int")
    for wrong in (
        lambda: tiling.tile_grid(images, 0),
        lambda: tiling.tile_grid(images, 640, 1.0),
        lambda: tiling.sample_tiles(images, -1),
        lambda: tiling.sample_tiles(images, save_all=True, only_empty=True),
        lambda: sampling.sample_pos_neg(images, gts, -0.5),
        lambda: sampling.sample_empties(images, gts, ratio=-1),
        lambda: sampling.sample_empties(images, gts, frac=1.5),
        lambda: sampling.staged_subsets(images, gts, (1.0, -1.0)),
        lambda: conversions.expand_box(gts, 0.5),
        lambda: steps.hard_negative_cycle(images, gts, lambda x: x, ratio=-1),
        lambda: in_ranges(images.withColumn("__place", F.lit(1)), "image_id"),
        lambda: sampling.lowest_hashes(images.withColumn("__h", F.lit(1)), images.agg(F.lit(1).alias("n")), "file_name"),
        lambda: jobs.retrain_trigger(images, 0),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_conversions_are_counted_in_their_pass(spark):
    lines = ["0 .5 .5 .1 .1", " 1  0.5 0.5 1 0 ", "0 .5 .5 .1", "", "0 2 .5 .1 .1", "0 a .5 .1 .1", "x .5 .5 .1 .1", "2 0 0 1 0 1 1 0 1", None]
    df = readers.with_label_format(spark.createDataFrame([(x,) for x in lines], "value string"))
    kept, seen = checks.converted(df, checks.label_line_ok(F.col("value")))
    assert sorted(r.value for r in kept.collect()) == sorted([lines[0], lines[1], lines[7]])
    assert seen.get == {"converted": 3, "skipped": 6}
    rows = {r.label_format: (r.lines, r.converted, r.skipped, r.uniform) for r in checks.conversion_report(df, checks.label_line_ok(F.col("value"))).collect()}
    assert rows == {"yolo": (5, 2, 3, False), "yolo-obb": (1, 1, 0, False), "unknown": (3, 0, 3, False)}


def test_lists_and_names(spark):
    table = lambda *x: spark.createDataFrame([(v,) for v in x], "category_name string")
    assert [r[0] for r in labels.both_lists(table("a", "b", "b"), table("b", "c")).collect()] == ["b"]


def test_round_of_learning(spark, tmp_path):
    images = spark.createDataFrame([(k, f"d/{k}.jpg", "d") for k in range(6)], "image_id bigint, file_name string, image_dir string")
    box = "image_id bigint, file_name string, category_id int, x_min double, y_min double, x_max double, y_max double"
    gts = spark.createDataFrame([(0, "d/0.jpg", 0, 0.0, 0.0, 10.0, 10.0, 1), (1, "d/1.jpg", 0, 0.0, 0.0, 10.0, 10.0, 2)], f"{box}, annotation_id bigint")
    dets = spark.createDataFrame([(0, "d/0.jpg", 0, 0.0, 0.0, 10.0, 10.0, 1, 0.9), (1, "d/1.jpg", 0, 50.0, 50.0, 60.0, 60.0, 2, 0.9), (5, "d/5.jpg", 0, 1.0, 1.0, 9.0, 9.0, 3, 0.9)], f"{box}, det_id bigint, score double")
    manifest = spark.createDataFrame([("train", "old"), ("val", "v"), ("test", "t")], "split string, dir string")
    found = steps.hard_negative_round(images, gts, manifest, lambda some: dets.join(some.select("image_id"), "image_id", "left_semi"), steps.CycleSettings(ratio=20, root="/data/"))
    assert {r.path for r in found["paths"].collect()} == {"/data/d/1.jpg", "/data/d/5.jpg"}
    assert {tuple(r) for r in found["manifest"].collect()} == {("val", "v"), ("test", "t"), ("train", "/data/d/1.jpg"), ("train", "/data/d/5.jpg")}
    none = steps.hard_negative_round(images, gts, manifest, lambda some: dets.join(some.select("image_id"), "image_id", "left_semi"), steps.CycleSettings(ratio=0))
    assert {r.path for r in none["paths"].collect()} == {"d/1.jpg"}
    steps.write_hard_negative_round(found, str(tmp_path), "/data", {0: "roan"})
    dirs, names = readers.read_manifest(spark, str(tmp_path / "manifest"))
    assert {tuple(r) for r in dirs.collect()} == {("train", f"{tmp_path}/images"), ("val", "/data/v"), ("test", "/data/t")} and names.count() == 1
    assert {r.path for r in readers.read_path_list(spark, str(tmp_path / "images")).collect()} == {"/data/d/1.jpg", "/data/d/5.jpg"}


def test_tile_function(spark):
    steps.register_tile_function(spark, "some_tiles")
    images = spark.createDataFrame([(1, "a", 1500, 700), (2, "b", 640, 640), (3, "c", 100, 2000)], "image_id bigint, file_name string, width int, height int")
    images.createOrReplaceTempView("some_images")
    for tile, overlap in ((640, 0.2), (300, 0.0), (512, 0.5)):
        want = {tuple(r) for r in tiling.tile_grid(images, tile, overlap).select("file_name", "x0", "y0", "x1", "y1").collect()}
        assert {tuple(r) for r in spark.sql(f"SELECT file_name, t.* FROM some_images, LATERAL some_tiles(width, height, {tile}, {overlap}D) AS t").collect()} == want


# rotated boxes


def test_rotated_boxes_by_cells(spark):
    rng = random.Random(8)
    rows = [(k % 3, k, rng.random() * 300, rng.random() * 300, 10 + rng.random() * 50, 10 + rng.random() * 50, rng.random() * math.pi, rng.choice([0.1, 0.5, 0.5, 0.9])) for k in range(150)]
    d = spark.createDataFrame(rows, "image_id bigint, det_id bigint, cx double, cy double, w double, h double, angle double, score double")
    want = {r.det_id for r in suppression.rotated_nms(d, 0.3).collect()}
    assert {r.det_id for r in suppression.rotated_nms(d, 0.3, cell=32).collect()} == want and 20 < len(want) < 150


# streams


def stream_of(spark, tmp_path, batches, schema, job, name):
    source = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = job(files)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / f"{name}-out")).collect()]


def test_whole_images(spark, tmp_path):
    """Images split over micro-batches come once and whole; rows after the watermark and images still open don't come."""
    at = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    rows = lambda *x: [(i, d, at(m)) for i, d, m in x]
    batches = [rows((1, 1, 0), (2, 2, 5)), rows((1, 3, 10), (3, 4, 20)), rows((2, 5, 30), (4, 6, 200)), rows((5, 8, 210)), rows((1, 7, 0), (6, 9, 400)), rows((1, 10, 401), (7, 11, 800))]
    got = stream_of(spark, tmp_path, batches, "image_id bigint, det_id bigint, ts string", lambda s: jobs.whole_images(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "60 minutes").select("image_id", "det_id"), "whole")
    assert sorted(got) == [(1, 1), (1, 3), (2, 2), (2, 5), (3, 4), (4, 6), (5, 8), (6, 9)]


def test_triggers_of_one_project(spark, tmp_path):
    batches = [[(1, t) for t in range(0, 50)] * 2, [(1, t) for t in range(30, 90)] + [(1, None), (2, 1)], [(2, t) for t in range(5)]]
    got = stream_of(spark, tmp_path, batches, "project_id int, task_id bigint", lambda s: jobs.retrain_trigger(s, 20), "trigger")
    assert sorted(got) == [(1, k, 20 * k) for k in range(1, 5)]


def test_distinct_images_are_exact(spark, tmp_path):
    rows = [(1, "roan", t % 40 if t % 10 else None, f"2024-01-01 0{t % 3}:10:00") for t in range(300)]
    batches = [rows[:100], rows[100:], [(1, "roan", 1, "2024-01-02 00:00:00")]]
    job = lambda s: jobs.label_counts_stream(s, "2 hours", "1 hour").select(F.hour("window_start"), "instances", "images")
    got = stream_of(spark, tmp_path, batches, "project_id int, label string, task_id bigint, ts string", job, "counts")
    want = []
    for start in (-1, 0, 1, 2):
        some = [t for _, _, t, ts in rows if start <= int(ts[11:13]) < start + 2]
        want.append((start % 24, len(some), len({t for t in some if t is not None})))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("buckets", [None, 7])
def test_hard_samples_of_streams_by_image(spark, tmp_path, buckets):
    """State has the partitions that were asked for; images are judged once, with buckets and without."""
    box = lambda k: (10 * k, 10 * k, 10 * k + 50, 10 * k + 50)
    dets = spark.createDataFrame([(k, k % 30, f"i{k % 30}.jpg", 1000, 1000, k % 3, *box(k % 50), 0.5 + k % 40 / 100) for k in range(300)], schemas.DETECTIONS)
    truth = spark.createDataFrame([(k, k % 40, f"i{k % 40}.jpg", 1000, 1000, k % 3, *box(k % 60)) for k in range(200)], schemas.GROUND_TRUTH)
    gts = written_in_buckets(truth.repartition(buckets, "image_id"), "image_id", buckets) if buckets else written(truth)
    timed = dets.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    timed.repartition(4, "det_id").write.parquet(source)
    timed.limit(1).withColumns({"image_id": F.lit(-1).cast("bigint"), "ts": F.lit("2025-01-01 00:00:00").cast("timestamp")}).coalesce(1).write.mode("append").parquet(source)
    batches = []

    def sink(df, batch_id):
        batches.append(batch_id)
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(source)
    with jobs.state_partitions(spark, 7):
        run = jobs.hard_samples_stream(stream, gts, sink, "ts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {o["numShufflePartitions"] for o in run.lastProgress["stateOperators"]} == {7} and len(batches) == 1
    columns = ["file_name", "by", "all_scores", "map50", "map75"]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert key(spark.read.parquet(out)) == key(selection.hard_samples(selection.image_table(dets, truth))) != []
