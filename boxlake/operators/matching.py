"""Detections against ground truth: pairs within an image, best matches, misses, confusion counts.

Pairs come from an equi-join on the image, never from a product of tables. For crowded images a cell
size spreads an image's boxes over grid cells, exact for every measure that needs an overlap.
All later groupings keep the image first, so the join's partitioning serves them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions import boxes
from boxlake.sources.shared import buckets_of, written, written_in_buckets

BOX = ("x_min", "y_min", "x_max", "y_max")
IMAGE = ("image_id", "file_name")


def clip_boxes(df: DataFrame) -> DataFrame:
    """Negative coordinates become 0."""
    return df.withColumns({c: boxes.clipped(F.col(c)) for c in BOX})


def _cells(df: DataFrame, size: int, side: str) -> DataFrame:
    """A row for each cell that a box touches; <side>_x and <side>_y are the first of its cells."""
    floor = lambda c: F.floor(F.col(c) / size)
    first = df.withColumns({f"{side}_{a}": F.least(floor(f"{a}_min"), floor(f"{a}_max")) for a in "xy"})
    return first.withColumn("cell_x", F.explode(F.sequence(floor("x_min"), floor("x_max")))).withColumn("cell_y", F.explode(F.sequence(floor("y_min"), floor("y_max"))))


def pairs(dets: DataFrame, gts: DataFrame, measure: str | Callable = "iou", cell: int | None = None, **more: str | Callable) -> DataFrame:
    """Detection and ground-truth box of one image with their measure: image_id, file_name, det_id, annotation_id,
    det_class, gt_class, score, value, and other measures under the names given. With cell, only pairs that share
    a cell, each once."""
    d = dets.select(*IMAGE, "det_id", F.col("category_id").alias("det_class"), "score", *(F.col(c).alias(f"d_{c}") for c in BOX), *BOX)
    g = gts.select("image_id", "annotation_id", F.col("category_id").alias("gt_class"), *(F.col(c).alias(f"g_{c}") for c in BOX), *BOX)
    on = ["image_id"]
    if cell:
        d, g, on = _cells(d, cell, "dc"), _cells(g, cell, "gc"), ["image_id", "cell_x", "cell_y"]
    joined = d.drop(*BOX).join(g.drop(*BOX), on)
    if cell:
        joined = joined.filter((F.col("cell_x") == F.greatest("dc_x", "gc_x")) & (F.col("cell_y") == F.greatest("dc_y", "gc_y")))  # the first cell of those they share
    values = [boxes.measure(m)(boxes.columns("d_"), boxes.columns("g_")).alias(name) for name, m in {"value": measure, **more}.items()]
    keys = (*IMAGE, "det_id", "annotation_id", "det_class", "gt_class", "score")
    # a generator of one row: filters on a measure stay above it, where below each would compute all of it again
    return joined.select(*keys, *values).select(*keys, F.inline(F.array(F.struct("value", *more))))


def _per_image(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    return df.join(other.select("image_id").distinct(), "image_id", how)


def match_predictions(dets: DataFrame, gts: DataFrame, threshold: float = 0.4, fp_mode: str = "image", measure: str | Callable = "ciou", cell: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """image_id, file_name, det_id, best_ciou, annotation_id, tp, fp for every detection.

    A detection is true if its best ground truth reaches the threshold; several may claim one, whatever
    their class. On images without ground truth each row counts all of the image's detections as false
    (fp_mode='image') or itself alone ('row'). near: pairs that the caller has already.
    """
    if fp_mode not in ("image", "row"):
        raise ValueError(f"fp_mode must be image or row, not {fp_mode!r}")
    n = buckets_of(dets, gts)
    dets = clip_boxes(dets)
    best = (pairs(dets, gts, measure, cell) if near is None else near).groupBy(*IMAGE, "det_id").agg(F.max(F.struct("value", (-F.col("annotation_id")).alias("neg"))).alias("b"))
    if cell and n:  # boxes of an image's cells meet where the image's rows are, and are read twice
        best = written_in_buckets(best, "image_id", n)
    hit = F.col("b.value") >= threshold
    matched = best.select(*IMAGE, "det_id", F.col("b.value").alias("best_ciou"), F.when(hit, -F.col("b.neg")).alias("annotation_id"), hit.cast("long").alias("tp"), (~hit).cast("long").alias("fp"))
    lone = _per_image(dets.select(*IMAGE, "det_id"), gts, "left_anti")
    count = F.count(F.lit(1)).over(Window.partitionBy("image_id")) if fp_mode == "image" else F.lit(1).cast("long")
    background = lone.select(*IMAGE, "det_id", F.lit(None).cast("double").alias("best_ciou"), F.lit(None).cast("bigint").alias("annotation_id"), F.lit(0).cast("long").alias("tp"), count.alias("fp"))
    if cell:  # detections that share no cell with ground truth of their image
        far = _per_image(dets.select(*IMAGE, "det_id"), gts, "left_semi").join(best.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
        background = background.unionByName(far.select(*IMAGE, "det_id", F.lit(None).cast("double").alias("best_ciou"), F.lit(None).cast("bigint").alias("annotation_id"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp")))
    return matched.unionByName(background)


def missed_ground_truth(dets: DataFrame, gts: DataFrame, threshold: float = 0.4, scope: str = "predicted", measure: str | Callable = "ciou", cell: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """image_id, file_name, annotation_id, fn = 1 of ground truth that no detection reaches. scope='predicted'
    looks only at images with detections, 'all' at every image."""
    if scope not in ("predicted", "all"):
        raise ValueError(f"scope must be predicted or all, not {scope!r}")
    dets = clip_boxes(dets)
    found = (pairs(dets, gts, measure, cell) if near is None else near).groupBy("image_id", "annotation_id").agg(F.max("value").alias("value")).filter(F.col("value") >= threshold)
    within = _per_image(gts, dets, "left_semi") if scope == "predicted" else gts
    return within.join(found, ["image_id", "annotation_id"], "left_anti").select(*IMAGE, "annotation_id", F.lit(1).cast("long").alias("fn"))


def image_error_counts(matches: DataFrame, missed: DataFrame) -> DataFrame:
    """image_id, file_name, tp, fp, fn and the ratios fp and fn to tp."""
    rows = matches.select(*IMAGE, "tp", "fp").unionByName(missed.select(*IMAGE, "fn"), allowMissingColumns=True)
    sums = rows.groupBy(*IMAGE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return sums.withColumns({"fp_tp_ratio": F.col("fp") / (F.col("tp") + 1e-8), "fn_tp_ratio": F.col("fn") / (F.col("tp") + 1e-8)})


def _class_counts(df: DataFrame, gt: Column, pred: Column, sign: int = 1) -> DataFrame:
    return df.groupBy(gt.cast("int").alias("gt_class"), pred.cast("int").alias("pred_class")).agg((sign * F.count(F.lit(1))).alias("n"))


def _confusion(dets: DataFrame, gts: DataFrame, hits: DataFrame, found: DataFrame, met: DataFrame, n_classes: int) -> DataFrame:
    """Cells of hits, detections without a hit (all but found) and ground truth without one (all but met): each
    side is counted by class, so nothing is joined back."""
    none, det, gt = F.lit(n_classes), F.col("det_class"), F.col("gt_class")
    parts = [_class_counts(hits, gt, det), _class_counts(dets, none, F.col("category_id")), _class_counts(found, none, det, -1), _class_counts(gts, F.col("category_id"), none), _class_counts(met, gt, none, -1)]
    return reduce(DataFrame.unionByName, parts).groupBy("gt_class", "pred_class").agg(F.sum("n").alias("n")).filter("n > 0")


def confusion_multi(dets: DataFrame, gts: DataFrame, n_classes: int, score: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """gt_class, pred_class, n: every pair that reaches the threshold counts; a detection with no pair counts
    in the background's row, ground truth with no pair of its class in the background's column (n_classes)."""
    dets = dets.filter(F.col("score") >= score)
    hits = written(pairs(dets, gts).filter(F.col("value") >= threshold).select("image_id", "det_id", "annotation_id", "det_class", "gt_class"))
    met = hits.filter("det_class = gt_class").select("image_id", "annotation_id", "gt_class").distinct()
    return _confusion(dets, gts, hits, hits.select("image_id", "det_id", "det_class").distinct(), met, n_classes)


def one_to_one(found: DataFrame, better: Column) -> DataFrame:
    """Pairs left when each detection keeps its best and then each ground truth its best of those."""
    d = Window.partitionBy("image_id", "det_id").orderBy(better, "annotation_id")
    g = Window.partitionBy("image_id", "annotation_id").orderBy(better, "det_id")
    first = found.withColumn("rank", F.row_number().over(d)).filter("rank = 1")
    return first.withColumn("rank", F.row_number().over(g)).filter("rank = 1").drop("rank")


def confusion_one_to_one(dets: DataFrame, gts: DataFrame, n_classes: int, score: float = 0.25, threshold: float = 0.6) -> DataFrame:
    """gt_class, pred_class, n with at most one pair for each detection and ground truth."""
    dets = dets.filter(F.col("score") > score)
    hits = written(one_to_one(pairs(dets, gts).filter(F.col("value") > threshold), F.col("value").desc()).select("det_class", "gt_class"))
    return _confusion(dets, gts, hits, hits, hits, n_classes)


def class_scores(confusion: DataFrame, n_classes: int) -> DataFrame:
    """class, precision, recall, f1 (rounded to 4 places) of every class but the background."""
    confusion = written(confusion)  # a row for each pair of classes
    tp = F.sum(F.when(F.col("gt_class") == F.col("pred_class"), F.col("n")).otherwise(0))
    actual = confusion.groupBy(F.col("gt_class").alias("class")).agg(F.sum("n").alias("actual"), tp.alias("tp"))
    pred = confusion.groupBy(F.col("pred_class").alias("class")).agg(F.sum("n").alias("pred"))
    joined = actual.join(pred, "class", "full_outer").filter(F.col("class") < n_classes).na.fill(0)
    p, r = F.col("tp") / (F.col("pred") + 1e-8), F.col("tp") / (F.col("actual") + 1e-8)
    return joined.select("class", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / (p + r + 1e-8), 4).alias("f1"))
