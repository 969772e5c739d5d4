"""Queries on summaries, order, checks, rounds of learning and the small tables around a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.functions import paths
from boxlake.operators import checks, labels, sampling, selection, stats, steps, suppression
from boxlake.plans import box_queries, evaluation_queries
from boxlake.plans.fixtures import TABLES, fixtures, with_tables
from boxlake.plans.registry import Registry
from boxlake.sources import readers
from boxlake.sources.shared import new_folder, written

R = Registry()

# summaries and order
_MEASURES = ["map50", "map75", "uncertainty", "max_score"]
_DESCRIBED = "count({0}) AS count, avg({0}) AS mean, stddev_samp({0}) AS std, min({0}) AS min, quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS q50, quantile_cont({0}, 0.75) AS q75, max({0}) AS max"
_ROUNDED = ", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in ("mean", "std", "min", "q25", "q50", "q75", "max"))
R.add(
    "describe_metrics",
    "fx_det fx_gt",
    lambda d, g: stats.describe(selection.image_table(d, g), _MEASURES),
    f'{evaluation_queries._TABLE}\nSELECT "column", count, {_ROUNDED} FROM (' + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_DESCRIBED.format(f"CAST({c} AS DOUBLE)")} FROM tab""" for c in _MEASURES) + ")",
    places=5,
)
R.add("describe_boxes", "fx_det", lambda d: stats.describe(d.withColumn("area", (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))), ["area", "score"]), f"""{with_tables('fx_det')}
SELECT "column", count, {_ROUNDED} FROM (SELECT 'area' AS "column", {_DESCRIBED.format("CAST((x_max - x_min) * (y_max - y_min) AS DOUBLE)")} FROM fx_det UNION ALL SELECT 'score', {_DESCRIBED.format("CAST(score AS DOUBLE)")} FROM fx_det)""", places=5)
R.add(
    "images_by_uncertainty",
    "fx_det",
    lambda d: selection.in_order(selection.image_uncertainty(d).withColumn("uncertainty", F.round("uncertainty", 6))).select("place", "file_name", "uncertainty"),
    f"{evaluation_queries.CIOU}\nSELECT row_number() OVER (ORDER BY u DESC, file_name) - 1 AS place, file_name, u AS uncertainty FROM (SELECT file_name, round(uncertainty, 6) + 0e0 AS u FROM entropy)",
)
R.add(
    "images_by_tp",
    "fx_det fx_gt",
    lambda d, g: selection.in_order(evaluation_queries._errors(d, g), "tp").select("place", "file_name", "tp"),
    f"{evaluation_queries.CIOU}\nSELECT row_number() OVER (ORDER BY tp DESC, file_name) - 1 AS place, file_name, tp FROM counts",
)
R.add(
    "match_rows",
    "fx_det fx_gt",
    lambda d, g: selection.match_rows(d, g).select("file_name", "pred_det_id", "pred_best_ciou", "pred_matching_gt", "tp", "fp", "gt_annotation_id", "fn", "map50", "map75"),
    f"""{evaluation_queries._TABLE},
rows_of AS (
  SELECT image_id, file_name, det_id AS pred_det_id, best_ciou AS pred_best_ciou, coalesce('{{"annotation_id":' || annotation_id || '}}', CASE WHEN best_ciou IS NULL OR best_ciou < 0.4e0 THEN 'None' END) AS pred_matching_gt, tp, fp, CAST(NULL AS BIGINT) AS gt_annotation_id, CAST(NULL AS BIGINT) AS fn FROM matches
  UNION ALL SELECT image_id, file_name, NULL, NULL, NULL, NULL, NULL, annotation_id, fn FROM missed)
SELECT x.file_name, pred_det_id, round(pred_best_ciou, 6) + 0e0 AS pred_best_ciou, pred_matching_gt, tp, fp, gt_annotation_id, fn, round(map50, 6) AS map50, round(map75, 6) AS map75 FROM rows_of x LEFT JOIN imap ON x.image_id = imap.image_id""",
)

# suppression and merging by class and of tiles
R.add("nms_per_class", "fx_det", lambda d: suppression.nms(d, 0.5, per_class=True).select("image_id", "det_id"), evaluation_queries.R.oracle["nms"].replace("PARTITION BY image_id ORDER BY", "PARTITION BY image_id, category_id ORDER BY").replace("SELECT image_id, det_id AS id", "SELECT image_id, category_id, det_id AS id").replace("SELECT image_id, k, [", "SELECT image_id, category_id, k, [").replace("SELECT r.image_id, r.k,", "SELECT r.image_id, r.category_id, r.k,").replace("r.image_id = s.image_id AND", "r.image_id = s.image_id AND r.category_id = s.category_id AND").replace("FROM s GROUP BY image_id)", "FROM s GROUP BY image_id, category_id)"))
R.add("concat_tile_detections", "fx_det", lambda d: suppression.merge_tile_detections(evaluation_queries._tiled(d), "concat").select("det_id", "x_min", "y_min", "x_max", "y_max"), f"{with_tables('fx_det')}\nSELECT det_id, x_min, y_min, x_max, y_max FROM fx_det")
R.add("merge_tile_detections_nmm", "fx_det", lambda d: suppression.merge_tile_detections(evaluation_queries._tiled(d), "nmm", 0.5, "ios"), evaluation_queries.R.oracle["nmm"])

# samples and lists
R.add("sample_empties_share", "fx_images fx_gt", lambda i, g: sampling.sample_empties(i, g, frac=0.3).select("file_name"), f"{with_tables('fx_images', 'fx_gt')}\nSELECT file_name FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_gt) QUALIFY row_number() OVER (ORDER BY md5('41:' || file_name), file_name) <= floor(0.3e0 * count(*) OVER ())")
R.add(
    "labels_in_both_lists",
    "fx_det fx_gt fx_label_map",
    lambda d, g, m: labels.both_lists(d.filter("score >= 0.9").join(m, "category_id"), g.filter("image_id % 5 = 0").join(m, "category_id")),
    f"{with_tables('fx_det', 'fx_gt', 'fx_label_map')}\nSELECT DISTINCT category_name FROM fx_label_map WHERE category_id IN (SELECT category_id FROM fx_det WHERE score >= 0.9e0) AND category_id IN (SELECT category_id FROM fx_gt WHERE image_id % 5 = 0)",
)
R.add("run_names", "fx_gt", lambda g: g.select(F.col("category_id").alias("class"), F.col("image_id").alias("image")).select("class", "image", paths.tagged_run("val", "class", "image").alias("run")).distinct(), f"{with_tables('fx_gt')}\nSELECT DISTINCT category_id AS class, image_id AS image, 'val#class' || category_id || '#image' || image_id AS run FROM fx_gt")

# label lines: some of four fields, some with a number out of range, some of nine fields
_BROKEN = "CASE WHEN annotation_id % 13 = 0 THEN concat(category_id, ' 0.5 0.5 0.1') WHEN annotation_id % 17 = 0 THEN concat(category_id, ' 1.5 0.5 0.1 0.1') WHEN annotation_id % 19 = 0 THEN concat(category_id, ' 0 0 1 0 1 1 0 1') WHEN annotation_id % 23 = 0 THEN concat(category_id, ' 0.5 x 0.1 0.1') ELSE concat(category_id, ' 0.5 0.5 0.1 0.1') END"


def _lines(y: DataFrame) -> DataFrame:
    return readers.with_label_format(y.select("annotation_id", F.expr(_BROKEN).alias("value")))


_KINDS = f"""{with_tables('fx_yolo')},
l AS (SELECT CASE WHEN annotation_id % 13 = 0 THEN 'unknown' WHEN annotation_id % 17 = 0 THEN 'yolo' WHEN annotation_id % 19 = 0 THEN 'yolo-obb' ELSE 'yolo' END AS label_format,
  NOT (annotation_id % 13 = 0 OR annotation_id % 17 = 0 OR (annotation_id % 19 <> 0 AND annotation_id % 23 = 0)) AS ok FROM fx_yolo)"""
R.add("label_conversion_report", "fx_yolo", lambda y: checks.conversion_report(_lines(y), checks.label_line_ok(F.col("value"))), f"{_KINDS}\nSELECT label_format, count(*) AS lines, count(*) FILTER (WHERE ok) AS converted, count(*) FILTER (WHERE NOT ok) AS skipped, count(*) OVER () = 1 AS uniform FROM l GROUP BY label_format")


def label_conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are converted and skipped, counted in the pass that writes the converted ones."""
    (yolo,) = fixtures(spark, sf_dir, "fx_yolo")
    kept, seen = checks.converted(_lines(yolo), checks.label_line_ok(F.col("value")))
    out = written(kept)
    counts = seen.get
    return out.agg(F.count(F.lit(1)).alias("written")).select("written", *(F.lit(counts[c]).cast("long").alias(c) for c in ("converted", "skipped")))


def label_config_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a labelling page that is written from the label map."""
    (names,) = fixtures(spark, sf_dir, "fx_label_map")
    folder = new_folder(spark)
    tags = names.agg(F.concat(F.lit("<View><RectangleLabels name='label' toName='image'>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<Label value='"), "category_name", F.lit("'/>")))), ""), F.lit("</RectangleLabels></View>")).alias("value"))
    tags.coalesce(1).write.text(folder)  # a label map is a few rows
    return readers.read_label_config(spark, folder)


def tiles_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all images by the SQL table function."""
    (images,) = fixtures(spark, sf_dir, "fx_images")
    steps.register_tile_function(spark, "image_tiles")
    images.createOrReplaceTempView("fx_tiled_images")
    return spark.sql("SELECT file_name, t.x0, t.y0, t.x1, t.y1 FROM fx_tiled_images, LATERAL image_tiles(width, height, 640, 0.2D) AS t")


# a round of hard-negative learning: a tenth as many empties as positives, scored by the detections there are
_SAMPLE = box_queries.R.oracle["sample_pos_neg"]
_IN_SAMPLE = f"fx_det_all AS ({TABLES['fx_det']}),\nsmp AS MATERIALIZED (SELECT image_id FROM fx_images WHERE file_name IN (SELECT file_name FROM ({_SAMPLE}))),\nfx_det AS (SELECT * FROM fx_det_all WHERE image_id IN (SELECT image_id FROM smp))"
_HARD = evaluation_queries.ORACLE["hard_samples"].replace(f"fx_det AS ({TABLES['fx_det']})", _IN_SAMPLE)


def _round(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    dets, gts, images = fixtures(spark, sf_dir, "fx_det", "fx_gt", "fx_images")
    folders = images.select("split", F.col("image_dir").alias("dir")).distinct()
    found = lambda some: dets.join(some.select("image_id"), "image_id", "left_semi")
    return steps.hard_negative_round(images, gts, folders, found, steps.CycleSettings(ratio=0.1))


def hard_negative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir)["paths"]


def hard_negative_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir)["manifest"]


QUERIES = R.queries | {q.__name__: q for q in (label_conversion_counts, label_config_file, tiles_by_function, hard_negative_paths, hard_negative_manifest)}
ORACLE = R.oracle | {
    "label_conversion_counts": f"{_KINDS}\nSELECT count(*) FILTER (WHERE ok) AS written, count(*) FILTER (WHERE ok) AS converted, count(*) FILTER (WHERE NOT ok) AS skipped FROM l",
    "label_config_file": f"{with_tables('fx_label_map')}\nSELECT category_name AS label FROM fx_label_map",
    "tiles_by_function": f"SELECT file_name, x0, y0, x1, y1 FROM ({box_queries.R.oracle['tile_grid']})",
    "hard_negative_paths": f"WITH h AS ({_HARD})\nSELECT DISTINCT file_name AS path FROM h",
    "hard_negative_manifest": f"WITH h AS ({_HARD}), i AS ({with_tables('fx_images')} SELECT * FROM fx_images)\nSELECT DISTINCT split, image_dir AS dir FROM i WHERE split <> 'train' UNION ALL SELECT 'train', file_name FROM (SELECT DISTINCT file_name FROM h)",
}
