"""Paths, names and urls of images and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_path(path: Column) -> Column:
    """images becomes labels everywhere, the suffix .txt."""
    return F.regexp_replace(F.replace(path, F.lit("images"), F.lit("labels")), r"\.[^.]+$", ".txt")


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def stem(path: Column) -> Column:
    name, suffix = basename(path), F.substring_index(basename(path), ".", -1)
    cut = (F.length(suffix) > 0) & (F.length(suffix) < F.length(name))
    return F.when(cut, F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)).otherwise(name)


def image_key(path: Column) -> Column:
    """The name up to its first dot."""
    return F.regexp_extract(basename(path), r"^[^.]*", 0)


def parse_tile_name(name: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 and parent of `<parent>_<n>_<x0>_<y0>_<x1>_<y1>.<ext>`; null where the name has another form."""
    of = stem(name)
    known = of.rlike(r"^.*_[^_]*_\d+_\d+_\d+_\d+$")  # the one pattern, which all columns share; parts are cut at their marks
    parent = F.substring(of, F.lit(1), F.length(of) - F.length(F.substring_index(of, "_", -5)) - 1)
    part = lambda k: F.when(known, F.substring_index(F.substring_index(of, "_", -k), "_", 1).cast("int"))
    return {c: part(k) for c, k in (("x0", 4), ("y0", 3), ("x1", 2), ("y1", 1))} | {"parent": F.when(known & (F.length(parent) > 0), F.concat(parent, F.lit(".jpg")))}


def decoded_name(path: Column) -> Column:
    """Base name of a percent-encoded path; a plus sign stays one."""
    return basename(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def task_image_url(path: Column, root: str = "", prefix: str = "/data/local-files/?d=") -> Column:
    """The path relative to root, percent-encoded but for slashes, behind the prefix."""
    relative = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    encoded = F.replace(F.replace(F.url_encode(F.ltrim(relative, F.lit("/"))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(prefix), encoded)


def posix_tail(path: Column, n: int = 2) -> Column:
    """The last n parts, with forward slashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")


def flat_coco_name(path: Column) -> Column:
    """Folder names, the nearest first, and the base name, joined by #."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    n = F.size(parts)
    return F.when(n > 0, F.array_join(F.concat(F.slice(F.reverse(parts), F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(parts, -1, 1)), "#"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def common_upload_dir(df: DataFrame, column: str = "path") -> DataFrame:
    """common_dir: the one directory of all paths, or their longest common prefix; fails without paths. The
    least and the greatest name have the prefix that all have."""
    ends = df.agg(F.min(dirname(F.col(column))).alias("a"), F.max(dirname(F.col(column))).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda k: F.substr("a", F.lit(1), k) == F.substr("b", F.lit(1), k))) - 1
    out = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.substr("a", F.lit(1), same))
    return ends.select(F.when(F.col("a").isNull(), F.raise_error(F.lit("no images"))).otherwise(out).alias("common_dir"))


def tagged_run(name: str, *columns: str) -> Column:
    """The run's name of each row of parameters, as ``tagged_run_name`` has it."""
    return F.concat_ws("#", F.lit(name), *(F.concat(F.lit(c), F.col(c).cast("string")) for c in columns))


def tagged_run_name(name: str, **parameters: object) -> str:
    return "#".join([name, *(f"{k}{v}" for k, v in parameters.items())])
