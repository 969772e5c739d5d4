"""Writers of labels, COCO documents, tasks, path lists and manifests. Parquet is the form to work with;
text for other tools is a file per image, COCO comes in shards unless one document is asked for."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.functions.paths import image_key
from boxlake.operators.conversions import CORNERS
from boxlake.operators.ordered import with_place

#: Bytes that are copied at once.
COPIED = 8 << 20
#: Bytes and files after which an archive of label files is closed.
PACKED, MEMBERS = 4 << 20, 1 << 14


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _label_lines(df: DataFrame, path: str, fields: list[Column], file: str, mode: str, packed: bool) -> None:
    """Lines without repeats in one file `<image_key>.txt` per image. An image's lines are put together by Spark and
    written by the task that has them, under another name first, so a task that runs again replaces its files.
    packed: the files are members of zip archives, since millions of them would take a disk's block each."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be errorifexists or overwrite, not {mode!r}")
    rows = df.select(image_key(F.col(file)).alias("image_key"), F.struct(*(f.alias(f"f{k}") for k, f in enumerate(fields))).alias("line"))
    text = lambda line: F.concat_ws(" ", *(line[f"f{k}"].cast("string") for k in range(len(fields))))
    files = rows.groupBy("image_key").agg(F.collect_list("line").alias("lines"))  # numbers are dealt out, which are smaller than their text
    files = files.select("image_key", F.array_join(F.array_sort(F.array_distinct(F.transform("lines", text))), "\n").alias("lines"))
    store, folder = _store(df.sparkSession, path)
    if store.exists(folder):
        if mode == "errorifexists":
            raise FileExistsError(path)
        store.delete(folder, True)
    store.mkdirs(folder)
    if packed:  # in order, so that a task that runs again makes the same archives
        files = files.sortWithinPartitions("image_key")
    files.mapInArrow(_put_archives(path) if packed else _put_files(path), "n_files bigint").agg(F.sum("n_files")).collect()


def _put_archives(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores
        from pyspark import TaskContext

        store, base = stores.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        place, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def put() -> None:
            nonlocal count, held, size
            if not held:
                return
            block = io.BytesIO()
            with zipfile.ZipFile(block, "w", zipfile.ZIP_DEFLATED) as archive:
                for key, data in held:
                    archive.writestr(zipfile.ZipInfo(f"{key}.txt"), data, zipfile.ZIP_DEFLATED)
            part = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(block.getvalue())
            store.move(part, f"{base}/part-{place:06d}-{count:06d}.zip")
            count, held, size = count + 1, [], 0

        for batch in batches:
            for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key, f"{lines}\n".encode()))
                size += len(held[-1][1])
                if size >= PACKED or len(held) >= MEMBERS:
                    put()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n_files"])
        put()

    return run


def _put_files(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for batch in batches:
            for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/_{key}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(f"{lines}\n".encode())
                store.move(part, f"{base}/{key}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n_files"])

    return run


def write_yolo_labels(df: DataFrame, path: str, file: str = "file_name", mode: str = "errorifexists", packed: bool = False) -> None:
    """`class x y w h` lines, without repeats, a file per image (its name up to the first dot); packed: in zip archives."""
    _label_lines(df, path, [F.col("category_id").cast("int"), *(F.col(c) for c in "xywh")], file, mode, packed)


def write_obb_labels(df: DataFrame, path: str, file: str = "file_name", mode: str = "errorifexists", packed: bool = False) -> None:
    _label_lines(df, path, [F.col("category_id").cast("int"), *(F.col(c) for c in CORNERS)], file, mode, packed)


def write_dota_labels(df: DataFrame, path: str, file: str = "file_name", mode: str = "errorifexists", packed: bool = False) -> None:
    _label_lines(df, path, [*(F.col(c).cast("int") for c in CORNERS), F.col("label_name"), F.col("difficulty")], file, mode, packed)


def coco_shards(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row per image: the image and its annotations as JSON, to be written in any number of files."""
    grouped = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "image_id", "category_id", "bbox", "segmentation", "area", "iscrowd"))).alias("annotations"))
    joined = images.join(grouped, images["id"] == grouped["image_id"], "left").drop("image_id")
    return joined.select(F.to_json(F.struct(F.struct("id", "width", "height", "file_name").alias("image"), F.coalesce("annotations", F.array().cast(grouped.schema["annotations"].dataType)).alias("annotations"))).alias("value"))


def coco_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """section, place, value: the lines of one COCO document, an item to a line. In the order of section and place they are the
    document, so ranges of them can be written side by side. Items go by id; no task holds a list of them."""
    sections = [(images, ["id", "width", "height", "file_name"]), (annotations, ["id", "image_id", "category_id", "bbox", "segmentation", "area", "iscrowd"]), (categories, ["id", "name"])]
    marks = ['{"info":{"description":""},"licenses":[],"images":[', '],"annotations":[', '],"categories":[', "]}"]
    out = images.sparkSession.createDataFrame([(2 * k, 0, x) for k, x in enumerate(marks)], "section int, place bigint, value string")
    for k, (df, fields) in enumerate(sections):
        items = with_place(df.select("id", F.to_json(F.struct(*fields)).alias("value")), ["id"], "place")
        out = out.unionByName(items.select(F.lit(2 * k + 1).alias("section"), "place", F.concat(F.when(F.col("place") > 0, F.lit(",")).otherwise(F.lit("")), "value").alias("value")))
    return out


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, one after another by name, as one file. One task copies bytes, of compressed parts
    what they hold; it has a block of them at a time."""
    store, where = _store(spark, folder)
    names = sorted(f.getPath().toString() for f in store.listStatus(where) if f.getPath().getName().startswith("part-"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores

        url = lambda x: x if ":/" in x else f"file://{x}"
        for batch in batches:
            to, target = stores.FileSystem.from_uri(url(batch.column(0)[0].as_py()))
            part = f"{target}.{uuid.uuid4().hex}"
            with to.open_output_stream(part) as out:
                for name in batch.column(1)[0].as_py():
                    source, at = stores.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", url(name)))
                    with source.open_input_stream(at) as block:
                        while piece := block.read(COPIED):
                            out.write(piece)
            to.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    spark.createDataFrame([(path, names)], "path string, names array<string>").mapInArrow(run, "n bigint").collect()


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row, value: the whole set as one COCO document, for sets of a few images; ``write_coco`` writes larger ones."""
    item = lambda df, cols: df.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("x"))
    i = item(images, ["id", "width", "height", "file_name"]).withColumnRenamed("x", "images")
    a = item(annotations, ["id", "image_id", "category_id", "bbox", "segmentation", "area", "iscrowd"]).withColumnRenamed("x", "annotations")
    c = item(categories, ["id", "name"]).withColumnRenamed("x", "categories")
    info, none = F.struct(F.lit("").alias("description")).alias("info"), F.array().cast("array<string>").alias("licenses")
    return i.crossJoin(a).crossJoin(c).select(F.to_json(F.struct(info, none, "images", "annotations", "categories")).alias("value"))  # one row each


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """single: one document, path/coco.json, whose ranges are written side by side and joined at the store."""
    if single:
        spark = images.sparkSession
        lines = coco_lines(images, annotations, categories).repartitionByRange("section", "place").sortWithinPartitions("section", "place")
        lines.select("value").write.mode(mode).option("compression", "gzip").text(f"{path}/_parts")
        join_files(spark, f"{path}/_parts", f"{path}/coco.json")
        store, parts = _store(spark, f"{path}/_parts")
        store.delete(parts, True)
    else:
        coco_shards(images, annotations).write.mode(mode).text(f"{path}/shards")
        categories.write.mode(mode).json(f"{path}/categories")


def label_tasks(boxes: DataFrame, images: DataFrame, model_version: str) -> DataFrame:
    """value: one pre-annotation task per image, its boxes as results, the highest score (0 without boxes). boxes
    has image_url and result; images has image_url."""
    grouped = boxes.groupBy("image_url").agg(F.collect_list("result").alias("result"), F.max("result.score").alias("score"))
    joined = images.select("image_url").distinct().join(grouped, "image_url", "left")
    result = F.coalesce("result", F.array().cast(grouped.schema["result"].dataType))
    prediction = F.struct(result.alias("result"), F.lit(model_version).alias("model_version"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return joined.select(F.to_json(F.struct(F.struct(F.col("image_url").alias("image")).alias("data"), F.array(prediction).alias("predictions"))).alias("value"))


def write_label_tasks(boxes: DataFrame, images: DataFrame, path: str, model_version: str, mode: str = "errorifexists") -> None:
    label_tasks(boxes, images, model_version).write.mode(mode).text(path)


def write_path_list(df: DataFrame, path: str, column: str = "file_name", mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).distinct().write.mode(mode).text(path)


def manifest_text(root: str, dirs: dict[str, list[str]], names: dict[int, str]) -> str:
    lines = [f"path: {root}"]
    for split in ("train", "val", "test"):
        lines += [f"{split}:", *(f"  - {d}" for d in dirs.get(split, []))]
    return "\n".join([*lines, f"nc: {len(names)}", "names:", *(f"  {k}: {v}" for k, v in sorted(names.items()))]) + "\n"


def write_manifest(spark, path: str, root: str, dirs: dict[str, list[str]], names: dict[int, str], mode: str = "errorifexists") -> None:
    """A page of text in a folder of its own, written by Spark so that any store will do."""
    spark.createDataFrame([(manifest_text(root, dirs, names),)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(path)


def write_metadata_jsonl(objects: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line per image with its nested objects."""
    objects.write.mode(mode).json(path)


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tile tables, statistics and metrics for spreadsheets."""
    df.write.mode(mode).option("header", "true").csv(path)
