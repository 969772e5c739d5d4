"""Queries whose result is documents, files or streams: compared by their rows, or by tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators import conversions, selection, stats, steps
from boxlake.plans import evaluation_queries
from boxlake.plans.fixtures import fixture, fixtures, with_tables
from boxlake.plans.registry import Registry, rounded
from boxlake.sources import writers
from boxlake.streaming import jobs

R = Registry()


def _coco_rows(y: DataFrame, i: DataFrame) -> tuple[DataFrame, DataFrame]:
    box = conversions.yolo_to_coco(y, i)
    annotations = box.select(F.col("annotation_id").alias("id"), "image_id", "category_id", F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox"), F.array("segmentation").alias("segmentation"), "area", "iscrowd")
    return i.select(F.col("image_id").alias("id"), "width", "height", "file_name"), annotations


def _field(path: str, kind: str = "string") -> Column:
    return F.get_json_object("value", path).cast(kind)


def _items(path: str) -> Column:
    return F.json_array_length(F.get_json_object("value", path)).cast("long")


R.add(
    "coco_document",
    "fx_yolo fx_images",
    lambda y, i: writers.coco_shards(*_coco_rows(y, i)).select(_field("$.image.id", "bigint").alias("image_id"), _field("$.image.file_name").alias("file_name"), _items("$.annotations").alias("n"), _field("$.annotations[0].id", "bigint").alias("first_id")),
    f"{with_tables('fx_yolo', 'fx_images')}\nSELECT i.image_id, i.file_name, count(annotation_id) AS n, min(annotation_id) AS first_id FROM fx_images i LEFT JOIN fx_yolo y ON y.image_id = i.image_id GROUP BY ALL",
)
R.add(
    "metadata_jsonl",
    "fx_images fx_gt",
    lambda i, g: stats.image_objects(i, g).select("file_name", F.to_json(F.struct("width", "height", "objects")).alias("value")).select("file_name", _field("$.width", "int").alias("width"), _items("$.objects.bbox").alias("n"), _field("$.objects.area[0]", "bigint").alias("first_area")),
    f"{with_tables('fx_images', 'fx_gt')}\nSELECT i.file_name, CAST(CASE WHEN count(annotation_id) = 0 THEN 2000 ELSE i.width END AS INT) AS width, count(annotation_id) AS n, CAST(arg_min((x_max - x_min) * (y_max - y_min), annotation_id) AS BIGINT) AS first_area FROM fx_images i LEFT JOIN fx_gt g USING (image_id) GROUP BY i.file_name, i.width",
)


def _tasks(d: DataFrame, i: DataFrame, m: DataFrame) -> DataFrame:
    results = conversions.box_to_percent_result(d.join(m, "category_id")).select(F.col("file_name").alias("image_url"), "result")
    return writers.label_tasks(results, i.select(F.col("file_name").alias("image_url")), "detector-1")


R.add(
    "label_task_json",
    "fx_det fx_images fx_label_map",
    lambda d, i, m: _tasks(d, i, m).select(_field("$.data.image").alias("image"), _items("$.predictions[0].result").alias("n"), _field("$.predictions[0].score", "double").alias("score"), _field("$.predictions[0].model_version").alias("model")),
    f"{with_tables('fx_det', 'fx_images')}\nSELECT i.file_name AS image, count(det_id) AS n, round(CAST(coalesce(max(score), 0) AS DOUBLE), 6) AS score, 'detector-1' AS model FROM fx_images i LEFT JOIN fx_det d USING (image_id) GROUP BY i.file_name",
)


_MATRIX = evaluation_queries.ORACLE["confusion_one_to_one"].replace("> 0.6e0", "> 0.5e0")
R.add(
    "classification_report",
    "fx_det fx_gt",
    lambda d, g: steps.classification_report(d, g, 6, top=4),
    f"""WITH m AS ({_MATRIX}),
a AS (SELECT gt_class AS class, sum(n) AS support, coalesce(sum(n) FILTER (WHERE gt_class = pred_class), 0) AS tp FROM m WHERE gt_class < 6 GROUP BY 1),
q AS (SELECT pred_class AS class, sum(n) AS pred FROM m GROUP BY 1),
s AS (SELECT class, CAST(support AS BIGINT) AS support, tp / (coalesce(pred, 0) + 1e-8) AS p, tp / (support + 1e-8) AS r FROM a LEFT JOIN q USING (class))
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r + 1e-8), 4) AS f1, support FROM s ORDER BY support DESC, class LIMIT 4""",
)
R.add("performance_report", "fx_det fx_gt", lambda d, g: steps.performance_report(d, g).select("file_name", "tp", "fp", "fn", "map50", "map75"), evaluation_queries.ORACLE["image_metrics"].replace(", map75 < 0.3e0 AS failed", ""))
R.add(
    "training_subset",
    "fx_det fx_gt fx_images",
    lambda d, g, i: selection.training_subset(selection.hard_samples(selection.image_table(d, g)), i.select("split", F.col("image_dir").alias("dir")).distinct())[1],
    f"WITH h AS ({evaluation_queries.ORACLE['hard_samples']}), i AS ({with_tables('fx_images')} SELECT * FROM fx_images)\nSELECT DISTINCT split, image_dir AS dir FROM i WHERE split <> 'train' UNION ALL SELECT 'train', file_name FROM (SELECT DISTINCT file_name FROM h)",
)


def _predictor() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Stands in for a caller's model: one box in each image, from its id."""

    def predict(images: pd.DataFrame) -> pd.DataFrame:
        x = (images["image_id"] % 500).astype(float)
        return pd.DataFrame({"image_id": images["image_id"], "file_name": images["file_name"], "x_min": x, "y_min": x, "x_max": x + 100, "y_max": x + 80, "score": (images["image_id"] % 100) / 100, "category_id": (images["image_id"] % 6).astype("int32")})

    return predict


R.add("score_images", "fx_images", lambda i: steps.score_images(i, _predictor).drop("file_name"), f"{with_tables('fx_images')}\nSELECT image_id, CAST(image_id % 500 AS DOUBLE) AS x_min, CAST(image_id % 500 AS DOUBLE) AS y_min, CAST(image_id % 500 + 100 AS DOUBLE) AS x_max, CAST(image_id % 500 + 80 AS DOUBLE) AS y_max, round((image_id % 100) / 100e0, 6) AS score, CAST(image_id % 6 AS INT) AS category_id FROM fx_images")


def _streamed(spark: SparkSession, table: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """table written to the shared folder, run through job as a stream to its end, and what came out."""
    from boxlake.sources.shared import written

    base = written(spark.range(1)).inputFiles()[0].rpartition("/")[0]  # a folder of the session's shared one
    source, out, state = (f"{base}/{kind}-{uuid.uuid4().hex}" for kind in ("source", "out", "state"))
    table.write.parquet(source)
    stream = job(spark.readStream.schema(table.schema).parquet(source))
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def label_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    results = fixture(spark, sf_dir, "fx_task_results").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(_streamed(spark, results, lambda s: jobs.label_counts_stream(s, "1 day")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "project_id", "label", "instances", "images"))


def label_counts_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin every day."""
    results = fixture(spark, sf_dir, "fx_task_results").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(_streamed(spark, results, lambda s: jobs.label_counts_stream(s, "2 days", "1 day")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "project_id", "label", "instances", "images"))


def retrain_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fixture(spark, sf_dir, "fx_task_results").select("project_id", "task_id")
    return _streamed(spark, results, lambda s: jobs.retrain_trigger(s, 50))


def retrain_trigger_one_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fixture(spark, sf_dir, "fx_task_results").select(F.lit(1).alias("project_id"), "task_id")
    return _streamed(spark, results, lambda s: jobs.retrain_trigger(s, 50))


def hard_samples_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard samples of images whose detections are split over files and micro-batches."""
    from boxlake.sources.shared import buckets_of, written

    taken = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("image_id") % 86_400)
    dets, gts = fixtures(spark, sf_dir, "fx_det", "fx_gt")
    n = buckets_of(dets, gts) or spark.sparkContext.defaultParallelism
    dets = dets.withColumn("ts", taken)
    base = written(spark.range(1)).inputFiles()[0].rpartition("/")[0]
    source, out, state, seen = (f"{base}/{kind}-{uuid.uuid4().hex}" for kind in ("source", "out", "state", "seen"))
    files = max(6, n)  # read in two micro-batches
    dets.repartition(files, "det_id").write.parquet(source)
    # a row of a later day, in a file of its own, ends the wait for all others
    last = dets.limit(1).withColumns({"image_id": F.lit(-1).cast("bigint"), "ts": F.timestamp_seconds(F.lit(1_900_000_000))})
    last.select(*dets.columns).coalesce(1).write.mode("append").parquet(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.drop("all_scores").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(source)
    with jobs.state_partitions(spark, n), jobs.state_on_disk(spark):
        run = jobs.hard_samples_stream(stream, gts, sink, "ts", "2 days", seen).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.parquet(out).drop("batch"))


QUERIES = R.queries | {q.__name__: q for q in (label_counts_stream, label_counts_sliding, retrain_trigger, retrain_trigger_one_project, hard_samples_stream)}
ORACLE = R.oracle | {
    "retrain_trigger": f"""{with_tables('fx_task_results')},
n AS (SELECT project_id, count(DISTINCT task_id) // 50 AS n FROM fx_task_results GROUP BY project_id)
SELECT project_id, CAST(t AS INT) AS trigger, CAST(50 * t AS BIGINT) AS n_tasks FROM (SELECT project_id, unnest(range(1, n + 1)) AS t FROM n)""",
    "retrain_trigger_one_project": f"""{with_tables('fx_task_results')}
SELECT CAST(1 AS INT) AS project_id, CAST(t AS INT) AS trigger, CAST(50 * t AS BIGINT) AS n_tasks FROM (SELECT unnest(range(1, count(DISTINCT task_id) // 50 + 1)) AS t FROM fx_task_results)""",
    "hard_samples_stream": evaluation_queries.ORACLE["hard_samples"],
    "label_counts_stream": f"""{with_tables('fx_task_results')}
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, project_id, label, count(*) AS instances, count(DISTINCT task_id) AS images FROM fx_task_results
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx_task_results) GROUP BY ALL""",
    "label_counts_sliding": f"""{with_tables('fx_task_results')},
w AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS day, f.* FROM fx_task_results f CROSS JOIN (SELECT unnest([0, 1]) AS k))
SELECT strftime(day, '%Y-%m-%d') AS day, project_id, label, count(*) AS instances, count(DISTINCT task_id) AS images FROM w
WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx_task_results) GROUP BY ALL""",
}
