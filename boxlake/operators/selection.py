"""Uncertainty of images and the choice of hard ones for the next labelling round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators import matching, metrics
from boxlake.operators.ordered import with_place
from boxlake.sources.shared import buckets_of, written, written_in_buckets

KEYS = ("image_id", "file_name")


def uncertainty(method: str = "entropy") -> Column:
    """Of an image's box scores: 'entropy' is the sum of -p ln p (a score of 0 adds nothing), '1-p' is 1 - mean."""
    p = F.col("score")
    if method == "entropy":
        return F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    if method == "1-p":
        return 1 - F.avg(p)
    raise ValueError(f"method must be entropy or 1-p, not {method!r}")


def image_uncertainty(dets: DataFrame, method: str = "entropy") -> DataFrame:
    return dets.groupBy(*KEYS).agg(uncertainty(method).alias("uncertainty"))


def _profile() -> list[Column]:
    s = F.col("score")
    return [F.count(F.lit(1)).alias("n"), F.max(s).alias("max_score"), F.min(s).alias("min_score"), F.avg(s).alias("mean_score"), F.median(s).alias("median_score"), F.var_pop(s).alias("var_score"), F.sort_array(F.collect_list(s), asc=False).alias("all_scores")]


def image_score_profile(dets: DataFrame) -> DataFrame:
    return dets.groupBy(*KEYS).agg(*_profile())


def _poor_by_errors(fp_tp: float = 0.2, fn_tp: float = 0.2) -> Column:
    return (F.col("fp_tp_ratio") > fp_tp) | (F.col("fn_tp_ratio") > fn_tp)


def _poor_by_quality(max_map: float = 0.3, score: float = 0.7, max_uncertainty: float = 4.0) -> Column:
    poor = (F.col("map50") < max_map) & (F.col("map75") < max_map)
    sure = (F.col("max_score") > score) | (F.col("max_score") < 1 - score)
    return (poor & sure) | (F.col("uncertainty") > max_uncertainty)


def hard_by_errors(counts: DataFrame, fp_tp: float = 0.2, fn_tp: float = 0.2) -> DataFrame:
    return counts.filter(_poor_by_errors(fp_tp, fn_tp))


def hard_by_quality(table: DataFrame, max_map: float = 0.3, score: float = 0.7, max_uncertainty: float = 4.0) -> DataFrame:
    """Poor on both thresholds while sure of itself (or sure of nothing), or of high uncertainty."""
    return table.filter(_poor_by_quality(max_map, score, max_uncertainty))


def image_table(dets: DataFrame, gts: DataFrame, method: str = "entropy", threshold: float = 0.4, scope: str = "predicted", fp_mode: str = "image") -> DataFrame:
    """One row per image: errors and ratios, map50, map75, score profile, uncertainty.

    Average precision deals boxes out by image and class by itself, which moves less than pairs of both measures. Errors are counts by image: of detections and ground truth, less
    those that have a pair over the threshold."""
    if scope not in ("predicted", "all") or fp_mode not in ("image", "row"):
        raise ValueError("scope must be predicted or all, fp_mode image or row")
    near = matching.pairs(matching.clip_boxes(dets), gts, "ciou").filter(F.col("value") >= threshold)
    good = near.select("image_id", "det_id", "annotation_id")
    good = written_in_buckets(good, "image_id", n) if (n := buckets_of(dets, gts)) else written(good)
    tp = good.groupBy("image_id", "det_id").agg(F.lit(1).alias("one")).groupBy("image_id").agg(F.count("one").alias("tp"))
    found = good.groupBy("image_id", "annotation_id").agg(F.lit(1).alias("one")).groupBy("image_id").agg(F.count("one").alias("found"))
    truth = gts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_gt")).join(tp, "image_id", "left").join(found, "image_id", "left")
    profile = dets.groupBy(*KEYS).agg(*_profile(), uncertainty(method).alias("uncertainty"))
    both = profile.join(truth, list(KEYS), "left" if scope == "predicted" else "full_outer")
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce("tp", F.lit(0))
    alone = n * n if fp_mode == "image" else n
    counts = both.withColumns({"tp": hits, "fp": F.when(F.col("n_gt").isNull(), alone).otherwise(n - hits), "fn": F.coalesce(F.col("n_gt") - F.coalesce("found", F.lit(0)), F.lit(0))}).drop("n_gt", "found")
    ratios = counts.withColumns({"fp_tp_ratio": F.col("fp") / (F.col("tp") + 1e-8), "fn_tp_ratio": F.col("fn") / (F.col("tp") + 1e-8)})
    return ratios.join(metrics.image_ap(dets, gts), list(KEYS), "left")


def in_order(table: DataFrame, by: str = "uncertainty", ascending: bool = False, name: str = "place") -> DataFrame:
    """table with its rows' places (from 0) by a column, then file_name; nulls come last. Rows are dealt out by ranges of the
    order and come sorted within them, so writing it gives sorted files in the order of their names."""
    column = F.col(f"`{by}`")
    null_last = F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0))
    keyed = table.withColumns({"__null": null_last, "__key": column if ascending else -column})
    placed = with_place(keyed, ["__null", "__key", "file_name"], name).drop("__null", "__key")
    return placed.repartitionByRange(name).sortWithinPartitions(name)


def match_rows(dets: DataFrame, gts: DataFrame, threshold: float = 0.4) -> DataFrame:
    """All match rows of an image with its metrics: detections as pred_ columns, misses as gt_ columns. Boxes are paired once for these; in
    tables of buckets by image they are paired where they lie, for detections and for misses, and only the result is written."""
    n = buckets_of(dets, gts)
    ciou = matching.pairs(matching.clip_boxes(dets), gts, "ciou").select(*KEYS, "det_id", "annotation_id", "value")
    ciou = ciou if n else written(ciou)
    found = matching.match_predictions(dets, gts, threshold, near=ciou).select(*KEYS, F.col("det_id").alias("pred_det_id"), F.col("best_ciou").alias("pred_best_ciou"), F.when(F.col("annotation_id").isNotNull(), F.to_json(F.struct("annotation_id"))).otherwise("None").alias("pred_matching_gt"), "tp", "fp")
    lost = matching.missed_ground_truth(dets, gts, threshold, near=ciou).select(*KEYS, F.col("annotation_id").alias("gt_annotation_id"), "fn")
    ap = metrics.image_ap(dets, gts)
    if not n:
        return found.unionByName(lost, allowMissingColumns=True).join(ap, list(KEYS), "left")
    ap = written_in_buckets(ap, "image_id", n)  # a union has no buckets, so its sides are joined
    return written(found.join(ap, list(KEYS), "left").unionByName(lost.join(ap, list(KEYS), "left"), allowMissingColumns=True), together=True)


def hard_samples(table: DataFrame, parity: bool = False, **limits: float) -> DataFrame:
    """Images chosen by errors, then those by quality; the first choice of a file wins. With parity the
    uncertainty of the first and the ratios of the second are left empty."""
    errors = _poor_by_errors(**{k: v for k, v in limits.items() if k in ("fp_tp", "fn_tp")})
    quality = _poor_by_quality(**{k: v for k, v in limits.items() if k not in ("fp_tp", "fn_tp")})
    chosen = table.withColumn("by", F.when(errors, F.lit("errors")).when(quality, F.lit("quality"))).filter("by IS NOT NULL")
    if parity:
        by_quality = F.col("by") == "quality"
        chosen = chosen.withColumns({"uncertainty": F.when(by_quality, F.col("uncertainty"))} | {c: F.when(~by_quality, F.col(c)) for c in ("fp_tp_ratio", "fn_tp_ratio")})
    first = F.row_number().over(Window.partitionBy("file_name").orderBy("by", "image_id"))
    out = chosen.withColumn("rank", first).filter("rank = 1")
    return out.select("file_name", "map50", "map75", "all_scores", "uncertainty", "fn_tp_ratio", "fp_tp_ratio", "by")


def failed(table: DataFrame, least: float = 0.3) -> DataFrame:
    return table.withColumn("failed", F.col("map75") < least)


def most_false_positives(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.col("fp").desc(), "file_name").limit(n)


def training_subset(hard: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen images' paths, and the manifest with the train split pointing at them."""
    paths = hard.select(F.col("file_name").alias("path")).distinct()
    kept = manifest.filter("split <> 'train'")
    return paths, kept.unionByName(paths.select(F.lit("train").alias("split"), F.col("path").alias("dir")))
