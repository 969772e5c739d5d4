"""Filters and maps of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_lists(keep: Sequence[str], discard: Sequence[str]) -> None:
    if both := sorted(set(keep) & set(discard)):
        raise ValueError(f"labels both kept and discarded: {both}")


def both_lists(keep: DataFrame, discard: DataFrame, column: str = "category_name") -> DataFrame:
    """Labels that two lists, given as tables, both hold: what ``check_lists`` fails on, for lists that the driver needn't hold."""
    return keep.select(column).intersect(discard.select(column))


def filter_labels(df: DataFrame, keep: Sequence[str] = (), discard: Sequence[str] = (), column: str = "category_name") -> DataFrame:
    """Rows whose label isn't discarded and, if any are to be kept, is one of them; null labels go."""
    check_lists(keep, discard)
    out = df.filter(F.col(column).isNotNull())
    if discard:
        out = out.filter(~F.col(column).isin(*discard))
    return out.filter(F.col(column).isin(*keep)) if keep else out


def dense_label_map(label_map: DataFrame, keep: Sequence[str] = (), discard: Sequence[str] = ()) -> DataFrame:
    """category_name, category_id (old), new_id from 0 in the old order; a label map is a few rows."""
    left = filter_labels(label_map, keep, discard)
    return left.withColumn("new_id", F.row_number().over(Window.orderBy("category_id")) - 1)


def map_labels(df: DataFrame, label_map: DataFrame, on: str = "category_id") -> DataFrame:
    """Adds the other side of the map; unmapped labels get null."""
    return df.join(label_map, on, "left")


def single_class(df: DataFrame, column: str = "category_id") -> DataFrame:
    return df.withColumn(column, F.lit(0))


def drop_result_label(tasks: DataFrame, label: str, results: str = "result") -> DataFrame:
    """Results of a label removed from tasks that have more than one result."""
    return tasks.withColumn(results, F.when(F.size(results) > 1, F.filter(results, lambda r: r["label"] != label)).otherwise(F.col(results)))


def score_at_least(df: DataFrame, least: float) -> DataFrame:
    return df.filter(F.col("score") >= least)


def max_detections(df: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each image, ties by det_id."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "det_id"))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def non_empty(images: DataFrame, boxes: DataFrame) -> DataFrame:
    return images.join(boxes.select("image_id").distinct(), "image_id", "left_semi")


def empty(images: DataFrame, boxes: DataFrame) -> DataFrame:
    return images.join(boxes.select("image_id").distinct(), "image_id", "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def first_tasks(tasks: DataFrame, n: int, inclusive: bool = False) -> DataFrame:
    """The first n tasks by id, 0 meaning all; inclusive takes one more."""
    return tasks if n == 0 else tasks.orderBy("task_id").limit(n + inclusive)


def all_but(images: DataFrame, positives: DataFrame) -> DataFrame:
    """Set difference by file_name."""
    return images.select("file_name").subtract(positives.select("file_name"))
