"""Files in every format, written and read."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.operators import conversions as cv
from boxlake.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_box_labels_of_both_formats(spark, tmp_path):
    put(tmp_path / "labels/a.txt", "0 0.5 0.5 0.1 0.2\n\n1 0.1 0.1 0.1 0.1\n")
    put(tmp_path / "labels/b.txt", "0 .45 .4 .55 .4 .55 .6 .45 .6\n")
    rows = {(r.image_key, r.category_id): r for r in readers.read_box_labels(spark, str(tmp_path / "labels")).collect()}
    assert rows["a", 0].label_format == "yolo" and rows["a", 0].h == 0.2 and rows["a", 0].x1 is None
    assert rows["b", 0].label_format == "yolo-obb" and rows["b", 0].y4 == 0.6
    put(tmp_path / "bad/c.txt", "0 1 2\n")
    with pytest.raises(Exception, match="neither 5 nor 9"):
        readers.read_box_labels(spark, str(tmp_path / "bad")).collect()


def test_yolo_round_trip_without_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "d/a.b.jpg", 0, 0.5, 0.25, 0.1, 0.2)] * 2, schemas.YOLO)
    writers.write_yolo_labels(df, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if p.suffix != ".crc"] == ["a.txt"]
    with pytest.raises(FileExistsError):
        writers.write_yolo_labels(df, str(tmp_path / "out"))
    row = readers.read_box_labels(spark, str(tmp_path / "out")).collect()
    assert len(row) == 1 and (row[0].image_key, row[0].x, row[0].y, row[0].w, row[0].h) == ("a", 0.5, 0.25, 0.1, 0.2)


def test_label_files_in_archives(spark, tmp_path, monkeypatch):
    """Many small files are members of few archives, each closed at a bound; they read back and list as single files do."""
    monkeypatch.setattr(writers, "MEMBERS", 50)
    df = spark.range(400).select(F.concat(F.lit("d/i"), F.col("id") % 300, F.lit(".jpg")).alias("file_name"), (F.col("id") % 3).cast("int").alias("category_id"), *(((F.col("id") % 7) / 10).alias(c) for c in "xywh"))
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    writers.write_yolo_labels(df, plain)
    writers.write_yolo_labels(df, packed, packed=True)
    files = [p for p in (tmp_path / "packed").iterdir() if p.suffix != ".crc"]
    assert len(files) < 30 and {p.suffix for p in files} == {".zip"} and max(len(zipfile.ZipFile(p).namelist()) for p in files) <= 50
    told = lambda rows: sorted((r.image_key, r.category_id, r.x, r.y, r.w, r.h) for r in rows.collect())
    assert told(readers.read_box_labels(spark, packed, packed=True)) == told(readers.read_box_labels(spark, plain))
    sizes = lambda rows: sorted((r.path.rpartition("/")[2], r.length) for r in rows.collect())
    assert sizes(readers.image_inventory(spark, packed, ("txt",), packed=True)) == sizes(readers.image_inventory(spark, plain, ("txt",)))
    with pytest.raises(FileExistsError):
        writers.write_yolo_labels(df, packed, packed=True)


def test_dota(spark, tmp_path):
    put(tmp_path / "d/a.txt", "450 400 550 400 550 600 450 600 buffalo 0\n0 0 1 0 1 1 0 1 buffalo 200\n0 0 1 0 1 1 0 1 zebra 0\n")
    rows = readers.read_dota_labels(spark, str(tmp_path / "d"), {"buffalo": 4}).collect()
    assert [(r.image_key, r.category_id, r.x3, r.difficulty) for r in rows] == [("a", 4, 550.0, 0)]
    images = spark.createDataFrame([(1, "a.jpg", "d", 1000, 1000, "train")], schemas.IMAGES)
    yolo = spark.createDataFrame([(1, 1, "a.jpg", 0, 0.5, 0.5, 0.1, 0.2)], schemas.YOLO)
    dota = cv.obb_to_dota(cv.yolo_to_obb(yolo), images, spark.createDataFrame([(0, "buffalo")], schemas.LABEL_MAP))
    writers.write_dota_labels(dota, str(tmp_path / "o"))
    assert [r.x1 for r in readers.read_dota_labels(spark, str(tmp_path / "o"), {"buffalo": 0}).collect()] == [450.0]


def test_coco_document(spark, tmp_path):
    images = spark.createDataFrame([(1, 10, 20, "a.jpg")], "id bigint, width int, height int, file_name string")
    ann = spark.createDataFrame([(1, 1, 0, [1.0, 2.0, 3.0, 4.0], [[1.0, 2.0]], 12.0, 0)], "id bigint, image_id bigint, category_id int, bbox array<double>, segmentation array<array<double>>, area double, iscrowd int")
    cats = spark.createDataFrame([(0, "buffalo")], "id int, name string")
    writers.write_coco(images, ann, cats, str(tmp_path / "coco"), single=True)
    i, a, c = readers.read_coco(spark, str(tmp_path / "coco"))
    assert (i.first().file_name, a.first().bbox, c.first().name) == ("a.jpg", [1.0, 2.0, 3.0, 4.0], "buffalo")
    writers.write_coco(images, ann, cats, str(tmp_path / "shards"))
    assert json.loads(spark.read.text(str(tmp_path / "shards/shards")).first()[0])["annotations"][0]["area"] == 12.0


def test_tasks(spark, tmp_path):
    value = {"x": 10, "y": 20, "width": 5, "height": 4, "rotation": 0, "rectanglelabels": ["roan"]}
    result = [{"original_width": 200, "original_height": 100, "value": value}]
    p = put(tmp_path / "t.json", json.dumps([{"id": 1, "project": 3, "data": {"image": "a.jpg"}, "annotations": [{"id": 9, "result": result}]}, {"id": 2, "project": 3, "data": {"image": "b.jpg"}, "annotations": []}]))
    rows = {r.task_id: r for r in cv.percent_result_to_box(readers.read_label_tasks(spark, p)).collect()}
    assert (rows[1].x_min, rows[1].y_max, rows[1].label) == (20.0, 24.0, "roan")
    assert 2 not in rows or rows[2].label is None
    assert readers.read_label_tasks(spark, p).count() == 2


def test_pre_annotations(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "a.jpg", 100, 100, 0, 10, 10, 20, 30, 0.5, "roan")], schemas.DETECTIONS + ", category_name string")
    boxes = cv.box_to_percent_result(d).select(F.col("file_name").alias("image_url"), "result")
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "image_url string")
    writers.write_label_tasks(boxes, images, str(tmp_path / "pre"), "m1")
    out = {t["data"]["image"]: t["predictions"][0] for t in (json.loads(r[0]) for r in spark.read.text(str(tmp_path / "pre")).collect())}
    assert out["a.jpg"]["score"] == 0.5 and out["a.jpg"]["result"][0]["value"]["height"] == 20
    assert out["b.jpg"] == {"result": [], "model_version": "m1", "score": 0.0}


def test_small_formats(spark, tmp_path):
    p = put(tmp_path / "c.xml", '<View><RectangleLabels><Label value="buffalo" background="red"/><Label value="roan"/></RectangleLabels></View>')
    assert sorted(r.label for r in readers.read_label_config(spark, p).collect()) == ["buffalo", "roan"]
    p = put(tmp_path / "m.json", '[{"id": 1, "name": "a"}, {"id": 4, "name": "b"}]')
    assert [(r.category_id, r.category_name) for r in readers.read_label_map(spark, p).collect()] == [(1, "a"), (4, "b")]
    p = put(tmp_path / "p.csv", "images,x,y,labels\na.jpg,1,2,3\nb.jpg,,,\n")
    assert readers.read_points_csv(spark, p).count() == 1
    p = put(tmp_path / "list.txt", "a.jpg\n\n b.jpg\n")
    assert [r.path for r in readers.read_path_list(spark, p).collect()] == ["a.jpg", "b.jpg"]
    p = put(tmp_path / "g.json", json.dumps({"type": "FeatureCollection", "features": [{"properties": {"IMAGEUUID": "u"}, "geometry": {"type": "Polygon", "coordinates": [[[-1, 2], [3, 4], [5, 6]]]}}]}))
    assert readers.read_geo_polygons(spark, p).first().points[0].x == -1.0
    p = put(tmp_path / "r.json", json.dumps([{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5}]))
    assert readers.read_coco_results(spark, p).first().bbox == [1, 2, 3, 4]
    p = put(tmp_path / "pred.json", json.dumps([{"file_name": "a", "x_min": 1, "score": 0.25}]))
    assert readers.read_predictions(spark, p).first().score == 0.25


def test_inventory_reads_no_content(spark, tmp_path):
    put(tmp_path / "images/a.JPG", "x")
    put(tmp_path / "images/sub/b.png", "xy")
    put(tmp_path / "images/c.txt", "no")
    df = readers.image_inventory(spark, str(tmp_path / "images"))
    assert sorted(r.length for r in df.collect()) == [1, 2] and "content" not in df.columns


def test_manifest(spark, tmp_path):
    writers.write_manifest(spark, str(tmp_path / "m"), "/data", {"train": ["a", "b"], "val": ["/c"]}, {0: "buffalo", 1: "roan"})
    dirs, names = readers.read_manifest(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in dirs.collect()} == {("train", "/data/a"), ("train", "/data/b"), ("val", "/c")}
    assert {tuple(r) for r in names.collect()} == {(0, "buffalo"), (1, "roan")}
    assert readers.parse_manifest("path: x # here\nnames: ['a', 'b']\nnc: 2\n") == {"path": "x", "names": ["a", "b"], "nc": 2}


def test_plain_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.jpg", 1.5)], "file_name string, score double")
    writers.write_predictions(df, str(tmp_path / "j"))
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_metadata_jsonl(df, str(tmp_path / "l"))
    writers.write_path_list(df, str(tmp_path / "p"))
    assert readers.read_predictions(spark, str(tmp_path / "j")).first().score == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().score == "1.5"
