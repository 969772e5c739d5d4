"""Readers of label files, task exports, predictions, points, polygons and manifests. Schemas are fixed."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.functions.paths import stem
from boxlake.operators.conversions import CORNERS

COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string>>, categories array<struct<id:int,name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,segmentation:array<array<double>>,area:double,iscrowd:int>>"
)
_VALUE = "struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>>"
TASKS = f"id bigint, project int, data struct<image:string>, annotations array<struct<id:bigint,result:array<struct<original_width:int,original_height:int,value:{_VALUE}>>>>"
PREDICTIONS = (
    "file_name string, x_min double, y_min double, bbox_w double, bbox_h double, x_max double, y_max double, score double, category_id int, category_name string, "
    "area double, gps string, Latitude double, Longitude double, Elevation double, px_Latitude double, px_Longitude double"
)
COCO_RESULTS = "image_id bigint, category_id int, bbox array<double>, score double"
GEO = "features array<struct<properties:struct<IMAGEUUID:string>,geometry:struct<type:string,coordinates:string>>>"
LABEL_MAP = "id int, name string"


def _members(spark: SparkSession, path: str, glob: str, listed: bool) -> DataFrame:
    """file_path, length, modificationTime of the files in zip archives of bounded size (the writers' packed form), and value, the
    lines of each. listed: by the archives' directories alone, a row a file, without value."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    when = archives.schema["modificationTime"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                with zipfile.ZipFile(io.BytesIO(batch.column(2)[k].as_py())) as archive:
                    found = [m for m in archive.infolist() if any(fnmatch.fnmatchcase(m.filename.rpartition("/")[2], g) for g in glob.split("|"))]
                    lines = [None if listed else re.split(r"\r\n|\r|\n", archive.read(m).decode()) for m in found]
                paths, sizes = [f"{batch.column(0)[k].as_py()}/{m.filename}" for m in found], [m.file_size for m in found]
                columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([batch.column(1)[k].as_py()] * len(found), batch.schema.field(1).type), pa.array(lines, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "length", "modificationTime", "value"])

    return archives.select("path", "modificationTime", "content").mapInArrow(run, f"file_path string, length bigint, modificationTime {when}, value array<string>")


def _lines(spark: SparkSession, path: str, glob: str, packed: bool = False) -> DataFrame:
    if packed:
        return _members(spark, path, glob, False).select(F.explode("value").alias("value"), "file_path").filter(F.trim("value") != "")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return text.select(F.col("value"), F.col("_metadata.file_path").alias("file_path")).filter(F.trim("value") != "")


def with_label_format(lines: DataFrame) -> DataFrame:
    """label_format of each line by its fields: 5 yolo, 9 yolo-obb, else unknown."""
    n = F.size(F.split(F.trim("value"), r"\s+"))
    return lines.withColumn("label_format", F.when(n == 5, F.lit("yolo")).when(n == 9, F.lit("yolo-obb")).otherwise(F.lit("unknown")))


def read_box_labels(spark: SparkSession, path: str, glob: str = "*.txt", packed: bool = False) -> DataFrame:
    """image_key, label_format, category_id, x, y, w, h (yolo) and the corners (yolo-obb); the others null.
    Lines of any other form fail the read when they are computed. packed: files in zip archives."""
    lines = with_label_format(_lines(spark, path, glob, packed)).withColumn("f", F.split(F.trim("value"), r"\s+"))
    wrong = F.raise_error(F.concat(F.lit("neither 5 nor 9 fields in "), F.col("file_path")))
    known = lines.withColumn("label_format", F.when(F.col("label_format") == "unknown", wrong).otherwise(F.col("label_format")))
    number = lambda k, kind: F.when(F.col("label_format") == kind, F.get("f", F.lit(k)).cast("double"))
    yolo = [number(k, "yolo").alias(c) for k, c in enumerate("xywh", 1)]
    obb = [number(k, "yolo-obb").alias(c) for k, c in enumerate(CORNERS, 1)]
    return known.select(stem(F.col("file_path")).alias("image_key"), "file_path", "label_format", F.get("f", F.lit(0)).cast("double").cast("int").alias("category_id"), *yolo, *obb)


def read_dota_labels(spark: SparkSession, path: str, classes: dict[str, int], max_difficulty: int = 100, packed: bool = False) -> DataFrame:
    """image_key, corners, label_name, difficulty, category_id; rows above max_difficulty and of classes that
    aren't listed drop out."""
    f = _lines(spark, path, "*.txt", packed).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") >= 9)
    rows = f.select(stem(F.col("file_path")).alias("image_key"), *(F.get("f", F.lit(k)).cast("double").alias(c) for k, c in enumerate(CORNERS)), F.get("f", F.lit(8)).alias("label_name"), F.coalesce(F.get("f", F.lit(9)).cast("int"), F.lit(0)).alias("difficulty"))
    names = spark.createDataFrame(list(classes.items()), "label_name string, category_id int")
    return rows.filter(F.col("difficulty") <= max_difficulty).join(names, "label_name")


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files of one JSON document (an object, or an array of rows) each, or of a row on every line."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


#: What items of a COCO document may hold, and keys that only items have.
_ITEM = (
    "id bigint, width int, height int, file_name string, name string, url string, image_id bigint, category_id int, "
    "bbox array<double>, segmentation array<array<double>>, area double, iscrowd int"
)
_ITEM_KEY = r'"(id|file_name|image_id|category_id|bbox)"\s*:'


def read_coco_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO documents of any size and layout: a file is cut at its opening braces, so tasks
    read ranges of one. An item's kind shows in its keys: images have file_name, annotations bbox or image_id, categories a
    name (and no url, which licences have). Items that hold braces themselves (masks as counts, braces in names) can't be cut so: they
    fail the read when it is computed, and ``read_coco`` with whole=True reads such documents."""
    found, has_key = spark.read.option("lineSep", "{").text(path), F.col("value").rlike(_ITEM_KEY)
    json = F.concat(F.lit("{"), F.substring_index("value", "}", 1), F.lit("}"))
    item = F.from_json(json, _ITEM, {"mode": "PERMISSIVE"})
    known = F.coalesce(item["file_name"], item["name"], item["image_id"].cast("string")).isNotNull()
    whole = F.col("value").contains("}") & item["id"].isNotNull() & known
    wrong = F.raise_error(F.concat(F.lit("not a plain COCO item, read the document as a whole: "), F.substring("value", 1, 100))).cast("struct<" + _ITEM.replace(" ", ":").replace(",:", ",") + ">")
    items = found.select(F.when(whole & has_key, item).when(has_key, wrong).alias("r")).select("r.*")  # what has no key is between items
    images = items.filter("file_name is not null").select("id", "width", "height", "file_name")
    annotations = items.filter("file_name is null and (image_id is not null or bbox is not null)").select("id", "image_id", "category_id", "bbox", "segmentation", "area", "iscrowd")
    categories = items.filter("file_name is null and image_id is null and bbox is null and name is not null and url is null").select(F.col("id").cast("int").alias("id"), "name")
    return images, annotations, categories


def read_coco(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories; whole: each document by one task, with all that JSON allows."""
    if not whole:
        return read_coco_split(spark, path)
    doc = _json(spark, path, COCO)
    return tuple(doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))


def read_label_tasks(spark: SparkSession, path: str, annotator_index: int = 0, lines: bool = False) -> DataFrame:
    """One row per result box (one with nulls for a task without): task_id, project, image, annotator_index,
    original size, px, py, pw, ph in percent, label."""
    tasks = _json(spark, path, TASKS, lines)
    rows = tasks.select(F.col("id").alias("task_id"), "project", F.col("data.image").alias("image"), F.lit(annotator_index).alias("annotator_index"), F.col("_metadata.file_path").alias("file_path"), F.explode_outer(F.get("annotations", F.lit(annotator_index))["result"]).alias("r"))
    v = F.col("r.value")
    return rows.select("task_id", "project", "image", "annotator_index", "file_path", F.col("r.original_width").alias("width"), F.col("r.original_height").alias("height"), v["x"].alias("px"), v["y"].alias("py"), v["width"].alias("pw"), v["height"].alias("ph"), F.get(v["rectanglelabels"], F.lit(0)).alias("label"))


def read_label_config(spark: SparkSession, path: str) -> DataFrame:
    """label names that the labelling page allows."""
    return spark.read.format("xml").option("rowTag", "Label").schema("_value string").load(path).select(F.col("_value").alias("label"))


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of prediction files; those of ``write_predictions`` have a row on every line."""
    return _json(spark, path, PREDICTIONS, lines)


def read_coco_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, COCO_RESULTS, lines)


def read_points_csv(spark: SparkSession, path: str, schema: str = "images string, x double, y double, labels int") -> DataFrame:
    """Points; rows with an empty field (images without animals) drop out."""
    return spark.read.option("header", "true").option("nanValue", "NaN").schema(schema).csv(path).na.drop()


def read_boxes_csv(spark: SparkSession, path: str, renamed: dict[str, str] | None = None) -> DataFrame:
    rows = spark.read.option("header", "true").schema("images string, x_min double, y_min double, x_max double, y_max double, labels int").csv(path).na.drop()
    return rows.withColumnsRenamed(renamed or {})


def read_geo_polygons(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """image_uuid and points of the outer ring of each polygon feature."""
    features = _json(spark, path, GEO, lines).select(F.explode("features").alias("f"))
    ring = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0]
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return features.filter("f.geometry.type = 'Polygon'").select(F.col("f.properties.IMAGEUUID").alias("image_uuid"), points.alias("points"))


def image_inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), packed: bool = False) -> DataFrame:
    """path, length and time of image files, whose content isn't read; packed: of those in zip archives, by their directories."""
    if packed:
        names = "|".join(f"*.{x}" for e in extensions for x in (e.lower(), e.upper()))
        return _members(spark, path, names, True).select(F.col("file_path").alias("path"), "length", "modificationTime")
    glob = "*.{" + ",".join(x for e in extensions for x in (e.lower(), e.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def read_label_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, LABEL_MAP, lines).select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))


def parse_manifest(text: str) -> dict:
    """A manifest's keys: scalars, lists (dashes or brackets) and one level of maps. The file is a page long."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        if body.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), _scalar(body.lstrip()[2:])]
            continue
        name, _, value = body.strip().partition(":")
        if body[0].isspace() and key:
            out[key] = {**(out[key] if isinstance(out[key], dict) else {}), _scalar(name): _scalar(value)}
        else:
            key = name.strip()
            out[key] = _scalar(value) if value.strip() else None
    return out


def _scalar(text: str):
    text = text.strip().strip("'\"")
    if text.startswith(("[", "{")):
        return json.loads(text.replace("'", '"'))
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(split, dir) with absolute folders, and (category_id, category_name)."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file
    m = parse_manifest(text)
    as_list = lambda v: v if isinstance(v, list) else [v] if v else []
    root = str(m.get("path") or "").rstrip("/")
    dirs = [(s, d if d.startswith("/") or not root else f"{root}/{d}") for s in ("train", "val", "test") for d in as_list(m.get(s))]
    names = m.get("names") or {}
    pairs = list(names.items()) if isinstance(names, dict) else list(enumerate(names))
    return spark.createDataFrame(dirs, "split string, dir string"), spark.createDataFrame([(int(k), str(v)) for k, v in pairs], "category_id int, category_name string")
