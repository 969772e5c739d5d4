"""Data-quality checks as reports: check and n_bad, in one pass over a table where they can share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()))
    items = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks))
    return row.select(F.explode(items).alias("c")).select("c.*")


def coordinate_checks(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    """Coordinates outside 0 to 1, and nulls, of each column."""
    return _report(df, {f"{c}_out_of_range": ~F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in columns} | {f"{c}_null": F.col(c).isNull() for c in columns})


def label_format_counts(lines: DataFrame) -> DataFrame:
    """label_format, n, and whether the set holds one format only."""
    counts = lines.groupBy("label_format").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("formats"))
    return counts.crossJoin(F.broadcast(total)).select("label_format", "n", (F.col("formats") == 1).alias("uniform"))


def require_uniform(lines: DataFrame) -> DataFrame:
    """lines, failing when they are computed if the set mixes formats."""
    n = lines.agg(F.count_distinct("label_format").alias("__formats"))
    ok = F.when(F.col("__formats") > 1, F.raise_error(F.lit("a directory must hold one label format")).cast("boolean")).otherwise(True)
    return lines.crossJoin(F.broadcast(n)).filter(ok).drop("__formats")


def conversion_report(lines: DataFrame, ok: Column) -> DataFrame:
    """label_format, lines, converted, skipped, uniform: of each format how many lines hold what a conversion asks for (ok), and
    whether the set has one format only."""
    good = F.coalesce(ok, F.lit(False))
    counts = lines.groupBy("label_format").agg(F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("converted"), F.count_if(~good).alias("skipped"))
    formats = counts.agg(F.count(F.lit(1)).alias("formats"))
    return counts.crossJoin(F.broadcast(formats)).select("label_format", "lines", "converted", "skipped", (F.col("formats") == 1).alias("uniform"))  # one row


def converted(df: DataFrame, ok: Column, name: str = "conversion") -> tuple[DataFrame, Observation]:
    """The rows that hold what a conversion asks for, and an observation of converted and skipped rows, which are counted in
    the pass that computes them; ``get`` waits for that pass."""
    seen, good = Observation(name), F.coalesce(ok, F.lit(False))
    return df.observe(seen, F.count_if(good).alias("converted"), F.count_if(~good).alias("skipped")).filter(good), seen


def label_line_ok(line: Column) -> Column:
    """Whether a label line has 5 or 9 fields, all numbers, and all but the class from 0 to 1."""
    fields = F.split(F.trim(line), r"\s+")
    numbers = F.transform(fields, lambda x: x.try_cast("double"))
    inside = F.forall(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda x: x.isNotNull() & x.between(0, 1))
    return F.size(fields).isin(5, 9) & numbers[0].isNotNull() & inside


def projects_per_file(results: DataFrame, file: str = "file_path") -> DataFrame:
    """Files with results of more than one project."""
    return results.groupBy(file).agg(F.count_distinct("project_id").alias("n_projects")).filter("n_projects > 1")


def missing_parents(tiles: DataFrame, images: DataFrame, parent: str = "parent") -> DataFrame:
    return tiles.join(images.select(F.col("file_name").alias(parent)).distinct(), parent, "left_anti")


def tasks_without_boxes(tasks: DataFrame, results: DataFrame) -> DataFrame:
    return tasks.join(results.select("task_id").distinct(), "task_id", "left_anti")


def quality_report(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """check, n_bad over a table of normalised boxes and its images."""
    known = images.select("image_id").distinct()
    orphans = boxes.join(known, "image_id", "left_anti").agg(F.lit("image_missing").alias("check"), F.count(F.lit(1)).alias("n_bad"))
    bare = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti").agg(F.lit("image_without_boxes").alias("check"), F.count(F.lit(1)).alias("n_bad"))
    return reduce(DataFrame.unionByName, [coordinate_checks(boxes), orphans, bare])


def check_parameters(**p: float | bool) -> None:
    """Raises ValueError on parameters that contradict each other or are out of range."""
    if p.get("tile", 1) <= 0:
        raise ValueError("tile must be positive")
    if not 0 <= p.get("overlap", 0) < 1:
        raise ValueError("overlap must be from 0 to under 1")
    if p.get("ratio", 0) < 0:
        raise ValueError("ratio must not be negative")
    if not 0 <= p.get("frac", 0) <= 1:
        raise ValueError("frac must be from 0 to 1")
    if p.get("factor", 1) < 1:
        raise ValueError("factor must be 1 or more")
    if p.get("overwrite") and p.get("load_cached"):
        raise ValueError("overwrite and load_cached exclude each other")
    if p.get("save_all") and p.get("only_empty"):
        raise ValueError("save_all and only_empty exclude each other")
