"""Average precision, precision-recall curves, point metrics and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions import boxes
from boxlake.operators.assignment import greedy_by_score, least_distance
from boxlake.operators.matching import BOX, clip_boxes, pairs
from boxlake.operators.ordered import in_ranges, running
from boxlake.sources.shared import written

#: Thresholds that per-image metrics are computed at.
THRESHOLDS = (0.5, 0.75)
#: Points of recall at which precision is read.
POINTS = 101


#: Detections of an image's class that average precision looks at where the caller sets nothing else.
MOST = 100
#: Cells over which the boxes of crowded images are paired.
CELL = 256


def best_scored(dets: DataFrame, most: int | None) -> DataFrame:
    """An image's detections of a class with the highest scores (then smallest det_id); all of them where most is None."""
    if most is None:
        return dets
    if most < 1:
        raise ValueError("max_detections must be 1 or more, or None")
    rank = F.row_number().over(Window.partitionBy("image_id", "category_id").orderBy(F.col("score").desc(), "det_id"))
    return dets.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def _ranked_options(dets: DataFrame, near: DataFrame) -> DataFrame:
    """image_id, file_name, category_id, dets: an image's detections of a class by falling score (then det_id), each
    with the ground truth of its class that near (pairs) has for it, best first."""
    same = near.filter(F.col("det_class") == F.col("gt_class"))
    options = same.groupBy("image_id", "det_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("neg"), "annotation_id"))).alias("options"))
    none = F.array().cast("array<struct<neg:double,annotation_id:bigint>>")
    ready = dets.select("image_id", "file_name", "category_id", "det_id", "score").join(options, ["image_id", "det_id"], "left").withColumn("options", F.coalesce("options", none))
    found = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "det_id", "options")))
    return ready.groupBy("image_id", "file_name", "category_id").agg(found.alias("dets"))


def _split(dets: DataFrame, gts: DataFrame, crowded: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Detections and ground truth of images and classes with at most so many detections, and those of the others."""
    if crowded is None:
        return dets, gts, None, gts
    keys = ["image_id", "category_id"]
    large = written(dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > crowded).select(*keys))
    return *(df.join(large, keys, "left_anti") for df in (dets, gts)), *(df.join(large, keys, "left_semi") for df in (dets, gts))


def _crowded_hits(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """image_id, file_name, category_id, threshold, det_id, score, hit of detections in crowded images, by the grouped matcher."""
    at = F.inline(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), F.col("hits").alias("hit")))
    found = greedy_by_score(clip_boxes(dets), gts, thresholds).select("image_id", "file_name", "category_id", "det_id", "score", at)
    return found.select("image_id", "file_name", "category_id", "threshold", "det_id", "score", "hit")


def _hits(threshold: float | Column) -> Column:
    """Of ``dets``: 1 for each detection that takes the free ground truth of highest IoU that reaches the threshold."""
    least = F.lit(threshold) if isinstance(threshold, float) else threshold
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, det: Column) -> Column:
        free = F.filter(det["options"], lambda o: (-o["neg"] >= least) & ~F.array_contains(acc["taken"], o["annotation_id"]))
        found = F.size(free) > 0
        return F.struct(F.when(found, F.array_append(acc["taken"], free[0]["annotation_id"])).otherwise(acc["taken"]).alias("taken"), F.array_append(acc["hits"], found.cast("int")).alias("hits"))

    return F.aggregate("dets", start, step, lambda a: a["hits"])


def _paired(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...], crowded: int | None, cell: int | None) -> DataFrame:
    near = pairs(clip_boxes(dets), gts, cell=cell or (CELL if crowded is not None else None))
    return near.filter((F.col("det_class") == F.col("gt_class")) & (F.col("value") >= min(thresholds)))


def greedy_hits(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, max_detections: int | None = None, crowded: int | None = None, cell: int | None = None) -> DataFrame:
    """image_id, file_name, category_id, threshold, det_id, score, hit for every detection, as ``_hits`` finds them, or for the
    max_detections of highest score. The fold runs over one image's boxes of a class; where there are more than ``crowded``,
    the grouped matcher takes them, of the same result, and the others' boxes are paired by cells."""
    dets = best_scored(dets, max_detections)
    small, truth, large, crowd = _split(dets, gts, crowded)
    near = _paired(small, truth, thresholds, crowded, cell)
    at = _ranked_options(small, near).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    folded = at.withColumn("hits", _hits(F.col("threshold")))
    rows = folded.select("image_id", "file_name", "category_id", "threshold", F.explode(F.arrays_zip(F.col("dets").alias("d"), F.col("hits").alias("h"))).alias("z"))
    rows = rows.select("image_id", "file_name", "category_id", "threshold", F.col("z.d.det_id").alias("det_id"), (-F.col("z.d.neg")).alias("score"), F.col("z.h").alias("hit"))
    return rows if large is None else rows.unionByName(_crowded_hits(large, crowd, thresholds))


def folded_ap(hits: Column, positives: Column) -> Column:
    """Interpolated precision at POINTS recalls of one ranking: the hits are walked from the last, so that the best
    precision from each one on is known. What they add is summed from the first on, as a running sum over the ranking would: a verdict
    at a threshold may hang on the last bit."""
    whole = F.aggregate(hits, F.lit(0), lambda a, h: a + h)
    start = F.struct(F.size(hits).alias("k"), whole.alias("tp"), F.lit(0.0).alias("best"), F.array().cast("array<double>").alias("parts"))

    def step(a: Column, h: Column) -> Column:
        best = F.greatest(a["best"], a["tp"] / a["k"])
        before = a["tp"] - h
        recalls = lambda tp: F.floor((POINTS - 1) * tp / positives)
        points = recalls(a["tp"]) - F.when(a["k"] == 1, F.lit(-1)).otherwise(recalls(before))
        parts = F.when(points > 0, F.array_append(a["parts"], best * points)).otherwise(a["parts"])  # POINTS of them at most
        return F.struct((a["k"] - 1).alias("k"), before.alias("tp"), best.alias("best"), parts.alias("parts"))

    return F.aggregate(F.reverse(hits), start, step, lambda a: F.aggregate(F.reverse(a["parts"]), F.lit(0.0), lambda s, x: s + x) / POINTS)


def _mean_of_classes(ap: Column) -> Column:
    """Mean of an image's ap that are not null, null if there are none: summed by category_id, so that the order in which rows
    come changes no bit of it."""
    found = F.sort_array(F.collect_list(F.when(ap.isNotNull(), F.struct("category_id", ap.alias("ap")))))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x["ap"]) / F.size(found))


def _class_ap(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """image_id, category_id, file_name, positives (null: none), n (detections, null: none), ap1, ap2 ... of every class that an image
    has in either table. Both are dealt out by image and class once, and all is folded where they meet."""
    keys = ["image_id", "category_id"]
    side = lambda df, p, *more: df.select(*keys, *more, *(F.col(c).alias(f"{p}_{c}") for c in BOX))
    met = side(clip_boxes(dets), "d", "file_name", "det_id", "score").join(side(gts, "g", "annotation_id"), keys, "left")
    value = boxes.iou(boxes.columns("d_"), boxes.columns("g_"))
    met = met.select(*keys, "file_name", "det_id", "score", F.when(value >= min(thresholds), F.struct((-value).alias("neg"), "annotation_id")).alias("option"))
    each = met.groupBy(*keys, "file_name", "det_id", "score").agg(F.sort_array(F.collect_list("option")).alias("options"))
    ranked = each.groupBy(*keys).agg(F.min("file_name").alias("det_file"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "det_id", "options"))).alias("dets"))
    truth = gts.groupBy(*keys).agg(F.min("file_name").alias("gt_file"), F.count(F.lit(1)).alias("positives"))
    both = ranked.join(truth, keys, "full_outer")
    ap = [F.when(F.col("positives").isNotNull(), F.coalesce(folded_ap(_hits(t), F.col("positives")), F.lit(0.0))).alias(f"ap{k}") for k, t in enumerate(thresholds)]
    return both.select(*keys, F.coalesce("det_file", "gt_file").alias("file_name"), "positives", F.size("dets").alias("n"), *ap)


def image_class_ap(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, near: DataFrame | None = None, max_detections: int | None = MOST, crowded: int | None = None) -> DataFrame:
    """image_id, file_name, category_id, threshold, ap of classes that have ground truth in the image. near: pairs
    that the caller has already. Hits and precision are folded where the image's boxes are; only sums leave."""
    keys = ["image_id", "file_name", "category_id"]
    dets = best_scored(dets, max_detections)
    if near is None and crowded is None:
        found = _class_ap(dets, gts, thresholds).filter("positives IS NOT NULL")
        return found.select(*keys, F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"ap{k}").alias("ap")) for k, t in enumerate(thresholds)))))
    small, truth, large, crowd = _split(dets, gts, crowded)
    near = _paired(small, truth, thresholds, crowded, None) if near is None else near.filter(F.col("value") >= min(thresholds))
    positives = gts.groupBy(*keys).agg(F.count(F.lit(1)).alias("positives"))
    ap = lambda hits: F.coalesce(folded_ap(hits, F.col("positives")), F.lit(0.0)).alias("ap")
    at = F.array(*(F.struct(F.lit(t).alias("threshold"), ap(_hits(t))) for t in thresholds))
    if large is None:
        return positives.join(_ranked_options(small, near), keys, "left").select(*keys, F.inline(at))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "det_id", "hit"))), lambda x: x["hit"])
    folded = _crowded_hits(large, crowd, thresholds).groupBy(*keys, "threshold").agg(ranked.alias("hits"))
    in_crowds = positives.join(folded, keys).select(*keys, "threshold", ap(F.col("hits")))
    others = positives.join(large.select("image_id", "category_id").distinct(), ["image_id", "category_id"], "left_anti")
    return others.join(_ranked_options(small, near), keys, "left").select(*keys, F.inline(at)).unionByName(in_crowds)


def image_ap(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, near: DataFrame | None = None, max_detections: int | None = MOST, crowded: int | None = None) -> DataFrame:
    """image_id, file_name, map50, map75 (a column for each threshold) of every image with detections: the mean over
    its ground truth's classes, -1 where it has none."""
    names = {t: f"map{round(100 * t)}" for t in thresholds}
    if near is None and crowded is None:  # images come from the same rows, so their list isn't made apart
        found = _class_ap(best_scored(dets, max_detections), gts, thresholds)
        means = found.groupBy("image_id").agg(F.min("file_name").alias("file_name"), F.max("n").alias("n"), *(_mean_of_classes(F.col(f"ap{k}")).alias(c) for k, c in enumerate(names.values())))
        return means.filter("n > 0").select("image_id", "file_name", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in names.values()))
    per_class = image_class_ap(dets, gts, thresholds, near, max_detections, crowded)
    means = per_class.groupBy("image_id").agg(*(_mean_of_classes(F.when(F.col("threshold") == t, F.col("ap"))).alias(c) for t, c in names.items()))
    images = dets.select("image_id", "file_name").distinct()
    return images.join(means, "image_id", "left").select("image_id", "file_name", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in names.values()))


def score_levels(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...], max_detections: int | None = None, crowded: int | None = None) -> DataFrame:
    """category_id, threshold, score, tp, n, positives: totals of all detections down to a score, beside hits and dets
    of the score itself. Scores are dealt out by ranges, so no task holds a class."""
    keys = ["category_id", "threshold"]
    levels = greedy_hits(dets, gts, thresholds, max_detections, crowded).groupBy(*keys, "score").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("dets"))
    positives = gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("positives"))
    totals = running(in_ranges(levels, *keys, F.col("score").desc()), keys, {"tp": ("sum", "hits"), "n": ("sum", "dets")})
    return totals.join(positives, "category_id").select(*keys, "score", "tp", "n", "positives", "hits", "dets")


def dataset_ap(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6), max_detections: int | None = MOST, crowded: int | None = None) -> DataFrame:
    """category_id, threshold, ap over the whole set: interpolated precision at POINTS recalls; detections of equal
    score count together. Of an image's class the max_detections of highest score count (None: all). A level's points are the recalls that it reaches and the level before doesn't."""
    keys = ["category_id", "threshold"]
    reached = lambda tp: F.floor((POINTS - 1) * tp / F.col("positives"))
    before = F.when(F.col("n") == F.col("dets"), F.lit(-1)).otherwise(reached(F.col("tp") - F.col("hits")))
    levels = score_levels(dets, gts, thresholds, max_detections, crowded).select(*keys, "score", (F.col("tp") / F.col("n")).alias("precision"), (reached(F.col("tp")) - before).alias("points"))
    best = running(in_ranges(levels, *keys, "score"), keys, {"best": ("max", "precision")})
    sums = best.groupBy(*keys).agg((F.sum(F.col("best") * F.col("points")) / POINTS).alias("ap"))
    every = gts.select("category_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return every.join(sums, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def pr_curve(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, max_detections: int | None = None, crowded: int | None = None) -> DataFrame:
    """category_id, score, precision, recall at every distinct score, of all detections unless max_detections is set."""
    return score_levels(dets, gts, (threshold,), max_detections, crowded).select("category_id", "score", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def to_points(df: DataFrame) -> DataFrame:
    """Boxes as their centres: px, py beside the other columns."""
    return df.withColumns({"px": (F.col("x_min") + F.col("x_max")) / 2, "py": (F.col("y_min") + F.col("y_max")) / 2})


def point_pairs(dets: DataFrame, gts: DataFrame, radius: float = 20.0) -> DataFrame:
    """Detections and ground truth of one image and class within radius: an equi-join on image, class and grid
    cell, the detection being put into the nine cells around it, so no product of tables is made."""
    cell = lambda c: F.floor(F.col(c) / radius)
    d = to_points(dets).select("image_id", "category_id", "det_id", "px", "py", F.explode(F.sequence(cell("px") - 1, cell("px") + 1)).alias("cx"), cell("py").alias("row"))
    d = d.select("*", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("cy"))
    g = to_points(gts).select("image_id", "category_id", "annotation_id", F.col("px").alias("gx"), F.col("py").alias("gy"), cell("px").alias("cx"), cell("py").alias("cy"))
    apart = (F.col("px") - F.col("gx")) * (F.col("px") - F.col("gx")) + (F.col("py") - F.col("gy")) * (F.col("py") - F.col("gy"))
    return d.join(g, ["image_id", "category_id", "cx", "cy"]).select("image_id", "category_id", "det_id", "annotation_id", apart.alias("value")).filter(F.col("value") <= radius * radius)


def point_matches(dets: DataFrame, gts: DataFrame, radius: float = 20.0) -> DataFrame:
    """image_id, category_id, det_id, annotation_id, value (squared distance) of the one-to-one assignment of points within
    radius: as many pairs as there can be and, of those assignments, the one of least total distance."""
    return least_distance(point_pairs(dets, gts, radius))


def point_metrics(dets: DataFrame, gts: DataFrame, radius: float = 20.0) -> DataFrame:
    """category_id, tp, fp, fn, precision, recall, f1, mae, mse, rmse (of counts per image with either kind)."""
    tp = point_matches(dets, gts, radius).groupBy("category_id").agg(F.count(F.lit(1)).alias("tp"))
    both = dets.select("image_id", "category_id", F.lit(1).alias("d"), F.lit(0).alias("g")).unionByName(gts.select("image_id", "category_id", F.lit(0).alias("d"), F.lit(1).alias("g")))
    counts = both.groupBy("image_id", "category_id").agg(F.sum("d").alias("d"), F.sum("g").alias("g"))
    gap = F.col("d") - F.col("g")
    sums = counts.groupBy("category_id").agg(F.sum("d").alias("dets"), F.sum("g").alias("gts"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))
    joined = sums.join(tp, "category_id", "left").na.fill(0, ["tp"])
    p, r = F.col("tp") / (F.col("dets") + 1e-8), F.col("tp") / (F.col("gts") + 1e-8)
    return joined.select("category_id", "tp", (F.col("dets") - F.col("tp")).alias("fp"), (F.col("gts") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-8)).alias("f1"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def parameter_sweep(dets: DataFrame, gts: DataFrame, scores: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7), thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """min_score, min_iou, tp, fp, fn, f1 of every setting, and whether it is the best (then the smallest).

    Pairs are found once; a detection carries its best IoU into every setting it passes, and only sums leave.
    """
    best = pairs(dets, gts).groupBy("image_id", "det_id").agg(F.max(F.struct("value", (-F.col("annotation_id")).alias("neg"))).alias("b"))
    rows = dets.select("image_id", "det_id", "score").join(best, ["image_id", "det_id"], "left")
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("min_score"), F.lit(t).alias("min_iou")) for s in scores for t in thresholds)))
    tried = rows.select("*", grid.alias("at")).filter("score >= at.min_score").select("image_id", "at.*", (F.coalesce(F.col("b.value"), F.lit(0.0)) >= F.col("at.min_iou")).alias("hit"), (-F.col("b.neg")).alias("annotation_id"))
    by_gt = tried.groupBy("min_score", "min_iou", "image_id", F.when(F.col("hit"), F.col("annotation_id")).alias("annotation_id")).agg(F.count(F.lit(1)).alias("n"))
    sums = by_gt.groupBy("min_score", "min_iou").agg(F.sum(F.col("annotation_id").isNotNull().cast("long")).alias("tp"), F.sum("n").alias("dets"))
    sums = written(sums, together=True)  # a row for each setting
    total = gts.agg(F.count(F.lit(1)).alias("gts"))
    out = sums.crossJoin(F.broadcast(total)).select("min_score", "min_iou", "tp", (F.col("dets") - F.col("tp")).alias("fp"), (F.col("gts") - F.col("tp")).alias("fn"), (2 * F.col("tp") / (F.col("dets") + F.col("gts"))).alias("f1"))
    rank = F.row_number().over(Window.orderBy(F.col("f1").desc(), "min_score", "min_iou"))  # one row per setting
    return out.withColumn("is_best", rank == 1)
