"""Reproducible samples: members are the lowest hashes of (seed, key), so a sample of fewer is part of a
sample of more, and order, partitioning and reruns don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.checks import check_parameters
from boxlake.operators.ordered import reserved

SEED = 41
#: Leading hex digits by which a global sample narrows down before it ranks what is left.
_DIGITS = 3


def seeded(key: Column | str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key) if isinstance(key, str) else key))


def lowest_hashes(df: DataFrame, counts: DataFrame, key: str, seed: int = SEED, by: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of df with the lowest hash; counts is one row with n, or with by one or more for each group: what else
    they hold is put beside the rows. Rows are counted by hash prefix, and only those of the prefix at the edge are
    ranked, so no task ranks all rows of a group."""
    reserved(df, "__h", "__p", "__here", "__upto", "__n", "__left", "__rank")
    more = [c for c in counts.columns if c != "n" and c not in by]
    hashed = df.withColumn("__h", seeded(key, seed)).withColumn("__p", F.substring("__h", 1, _DIGITS))
    hist = hashed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__here"))
    upto = hist.withColumn("__upto", F.sum("__here").over(Window.partitionBy(*by).orderBy("__p")))  # at most 16**_DIGITS rows a group
    wanted = counts.withColumnRenamed("n", "__n")
    wanted = upto.join(wanted, list(by)) if by else upto.crossJoin(F.broadcast(wanted))
    cut = wanted.filter("__upto - __here < __n").select(*by, *more, "__p", F.when(F.col("__upto") > F.col("__n"), F.col("__n") - F.col("__upto") + F.col("__here")).alias("__left"))
    near = hashed.join(cut if by else F.broadcast(cut), [*by, "__p"])
    rank = F.row_number().over(Window.partitionBy(*by, *more, "__p").orderBy("__h", key))
    whole = near.filter("__left IS NULL").drop("__h", "__p", "__left")
    edge = near.filter("__left IS NOT NULL").withColumn("__rank", rank).filter("__rank <= __left").drop("__h", "__p", "__left", "__rank")
    return whole.unionByName(edge)


def _marked(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """images with positive: whether they have boxes."""
    has = boxes.select("image_id").distinct().withColumn("has", F.lit(1))
    return images.join(has, "image_id", "left").withColumn("positive", F.col("has").isNotNull()).drop("has")


def sample_pos_neg(images: DataFrame, boxes: DataFrame, ratio: float = 1.0, seed: int = SEED) -> DataFrame:
    """All images with boxes, and of those without min(int(with * ratio), without) in each image_dir."""
    check_parameters(ratio=ratio)
    marked = _marked(images, boxes)
    wanted = marked.filter("positive").groupBy("image_dir").agg(F.floor(F.count(F.lit(1)) * ratio).alias("n"))
    negatives = lowest_hashes(marked.filter("NOT positive"), wanted, "file_name", seed, ("image_dir",))
    return marked.filter("positive").unionByName(negatives.select(marked.columns))


def sample_empties(images: DataFrame, boxes: DataFrame, ratio: float | None = None, frac: float | None = None, seed: int = SEED) -> DataFrame:
    """Empty images: floor(boxes * ratio) of them, or the share frac."""
    if (ratio is None) == (frac is None):
        raise ValueError("give either ratio or frac")
    check_parameters(**{k: v for k, v in (("ratio", ratio), ("frac", frac)) if v is not None})
    bare = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti")
    base, share = (boxes, ratio) if ratio is not None else (bare, frac)
    return lowest_hashes(bare, base.agg(F.floor(F.count(F.lit(1)) * share).alias("n")), "file_name", seed)


def staged_subsets(images: DataFrame, boxes: DataFrame, ratios: tuple[float, ...], seed: int = SEED) -> DataFrame:
    """ratio and the images of its subset, for every ratio; empties are taken by rising hash, so subsets nest."""
    for ratio in ratios:
        check_parameters(ratio=ratio)
    marked = _marked(images, boxes)
    grid = F.explode(F.array(*map(F.lit, ratios))).alias("ratio")
    counts = marked.filter("positive").groupBy("image_dir").agg(F.count(F.lit(1)).alias("n")).select("image_dir", "n", grid)
    counts = counts.withColumn("n", F.floor(F.col("n") * F.col("ratio")))
    empties = lowest_hashes(marked.filter("NOT positive"), counts, "file_name", seed, ("image_dir",))
    return marked.filter("positive").select("*", grid).unionByName(empties)
