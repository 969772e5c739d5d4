"""Counts, balances, weights and correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.operators.ordered import in_ranges, running
from boxlake.sources.shared import written


def _named(df: DataFrame, label_map: DataFrame) -> DataFrame:
    return df.join(label_map, "category_id", "left")


def instances_per_class(gts: DataFrame, label_map: DataFrame) -> DataFrame:
    return _named(gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")), label_map).select(F.col("category_name").alias("class"), "n")


def images_per_class(gts: DataFrame, label_map: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("image_id") if approximate else F.count_distinct("image_id")
    return _named(gts.groupBy("category_id").agg(count.alias("n")), label_map).select(F.col("category_name").alias("class"), "n")


#: The dashboard's "images" column counts rows; kept under its own name.
rows_per_class = instances_per_class


def split_balance(images: DataFrame, gts: DataFrame) -> DataFrame:
    """split, images, non_empty, empty; the row with split 'all' holds the totals."""
    has = gts.select("image_id").distinct().withColumn("has", F.lit(1))
    joined = images.select("image_id", "split").join(has, "image_id", "left")
    out = joined.rollup("split").agg(F.count(F.lit(1)).alias("images"), F.count("has").alias("non_empty"), F.grouping("split").alias("total"))
    return out.select(F.when(F.col("total") == 1, F.lit("all")).otherwise(F.col("split")).alias("split"), "images", "non_empty", (F.col("images") - F.col("non_empty")).alias("empty"))


def class_by_dir(images: DataFrame, gts: DataFrame, names: dict[int, str]) -> DataFrame:
    """image_dir and a column of counts for each class, 0 where there are none."""
    joined = gts.select("image_id", "category_id").join(images.select("image_id", "image_dir"), "image_id")
    wide = joined.groupBy("image_dir").pivot("category_id", list(names)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("image_dir", *(F.col(str(k)).alias(v) for k, v in names.items()))


def project_stats(results: DataFrame) -> DataFrame:
    """project_id, label, instances, images: boxes of a label and the tasks that have it."""
    return results.groupBy("project_id", "label").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("task_id").alias("images"))


def annotator_stats(results: DataFrame, key: str = "annotator_id") -> DataFrame:
    return results.groupBy("project_id", key, "label").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("task_id").alias("images"))


def class_weights(gts: DataFrame, images: DataFrame, empty_ratio: float = 1.0) -> DataFrame:
    """category_id (0 the background, others moved up by one), freq, weight. Sampled empties count with the
    boxes; a class weighs 1 / (freq + 1e-6), the background 1."""
    per_class = gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    n_boxes = gts.agg(F.count(F.lit(1)).alias("boxes"))
    n_empty = images.join(gts.select("image_id").distinct(), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("empties"))
    totals = n_boxes.crossJoin(n_empty).select((F.col("boxes") + F.least(F.floor(F.col("boxes") * empty_ratio), F.col("empties"))).alias("total"))
    joined = per_class.crossJoin(F.broadcast(totals))  # one row of totals
    freq = F.col("n") / F.col("total")
    classes = joined.select((F.col("category_id") + 1).alias("category_id"), freq.alias("freq"), (1 / (freq + 1e-6)).alias("weight"))
    background = totals.select(F.lit(0).alias("category_id"), F.lit(None).cast("double").alias("freq"), F.lit(1.0).alias("weight"))
    return background.unionByName(classes)


def metric_correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """first, second, corr of every pair of columns, in one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = table.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def describe(table: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), approximate: bool = False) -> DataFrame:
    """column, count, mean, std (of a sample), min, q25, q50, q75 (a column for each quantile), max of numbers that aren't null. Quantiles
    are exact, between the two nearest values in proportion: equal values are counted first, and what is dealt out by ranges is a row
    for each value and its count, so neither a column nor the repeats of a value meet in one task. approximate takes Spark's sketch, in the one pass of the other measures."""
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must be from 0 to 1")
    names = [f"q{round(100 * q):02d}" for q in quantiles]
    values = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))).alias("v")).select("v.*").filter("value IS NOT NULL")
    v = F.col("value")
    measures = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    if approximate:
        sketch = F.percentile_approx(v, list(quantiles), 10_000)
        out = values.groupBy("column").agg(*measures, sketch.alias("at")).select("*", *(F.col("at")[i].alias(n) for i, n in enumerate(names)))
    else:
        rows = in_ranges(values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "column", "value")
        n = F.col("n")
        means = rows.groupBy("column").agg(F.sum("n").alias("count"), (F.sum(n * v) / F.sum("n")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
        apart = (v - F.col("mean")) * (v - F.col("mean"))
        spread = rows.join(F.broadcast(means.select("column", "count", "mean")), "column").groupBy("column").agg(F.sqrt(F.try_divide(F.sum(n * apart), F.max("count") - 1)).alias("std"))
        sums = written(means.join(spread, "column"))  # a row for each column
        # an order's places on both sides of each quantile
        far = lambda q: (F.col("count") - 1) * F.lit(float(q))
        ends = F.array(*(F.struct(F.lit(n).alias("q"), (F.floor(far(q)) + side).alias("place"), (far(q) - F.floor(far(q)) if side else 1 - far(q) + F.floor(far(q))).alias("share")) for n, q in zip(names, quantiles, strict=True) for side in (0, 1)))
        wanted = sums.select("column", F.explode(ends).alias("e")).select("column", "e.*").filter("share > 0")
        placed = running(rows, ["column"], {"upto": ("sum", "n")}).select("column", "value", "upto", (F.col("upto") - n).alias("before"))
        at = placed.join(F.broadcast(wanted), "column").filter("place >= before AND place < upto").groupBy("column").agg(*(F.sum(F.when(F.col("q") == n, v * F.col("share"))).alias(n) for n in names))
        out = sums.join(at, "column")
    return out.select("column", "count", "mean", "std", "min", *names, "max")


def mean_objective(table: DataFrame) -> DataFrame:
    """Means over images with ground truth, and the objective a search would lower."""
    scored = table.filter("map50 >= 0")
    return scored.agg(F.avg("map50").alias("map50"), F.avg("map75").alias("map75")).withColumn("objective", -F.col("map50") - F.col("map75"))


def top_classes(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "class").limit(n)


def task_scores(dets: DataFrame) -> DataFrame:
    """file_name, n, max_score: what a pre-annotation shows; images without boxes score 0."""
    return dets.groupBy("file_name").agg(F.count("det_id").alias("n"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))


def image_objects(images: DataFrame, boxes: DataFrame, width: int = 2000, height: int = 2000) -> DataFrame:
    """A row per image with nested objects (boxes, categories, areas); images without boxes have empty
    arrays and the fixed size."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    item = F.struct("annotation_id", F.array("x_min", "y_min", w, h).alias("bbox"), "category_id", (w * h).alias("area"))
    grouped = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("o"))
    joined = images.select("image_id", "file_name", "width", "height").join(grouped, "image_id", "left")
    none = F.array().cast("array<int>")
    objects = F.struct(F.coalesce("o.bbox", F.array().cast("array<array<int>>")).alias("bbox"), F.coalesce("o.category_id", none).alias("categories"), F.coalesce("o.area", none).alias("area"))
    return joined.select("file_name", F.when(F.col("o").isNull(), F.lit(width)).otherwise(F.col("width")).alias("width"), F.when(F.col("o").isNull(), F.lit(height)).otherwise(F.col("height")).alias("height"), objects.alias("objects"))
