"""Places and running sums in an order, dealt out by ranges of it, so that no task holds a group or the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.sources.shared import written


def reserved(df: DataFrame, *names: str) -> None:
    """Fails before anything runs if df has columns that an operator uses for itself."""
    if taken := sorted({c.lower() for c in df.columns} & set(names)):
        raise ValueError(f"columns {taken} must be renamed first")


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with __range and __place: rows of a range come before those of the next, and have their places inside it.
    Rows that are equal in the order get places of their own. The table is written, so places are the same whenever
    they are read."""
    reserved(df, "__range", "__place")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = written(placed)  # the upper bits of this id count partitions, the lower 33 their rows
    return rows.withColumn("__range", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))


def with_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows numbered 0, 1, 2 ... in this order. A table of one row a range goes through one task, and to all."""
    rows = in_ranges(df, *order)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    return rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place")).drop("__start", "__place", "__range")


def running(rows: DataFrame, by: list[str], down: dict[str, tuple[str, str]]) -> DataFrame:
    """rows (of ``in_ranges``) with columns {name: (function, column)}: sum, max or xor of a column over the rows of the same
    ``by`` up to this one. The order must put rows of one ``by`` together. Ranges are folded side by side, and what
    went before a range is folded over one row for each range of a ``by``."""
    fold = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}
    ends = rows.groupBy(*by, "__range").agg(*(fold[how](c).alias(f"__{name}") for name, (how, c) in down.items()))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*by, "__range", *(fold[how](f"__{name}").over(earlier).alias(f"__{name}") for name, (how, _) in down.items()))
    inside = Window.partitionBy("__range", *by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, [*by, "__range"])
    plus = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))}  # greatest skips nulls
    return joined.withColumns({name: plus[how](fold[how](c).over(inside), F.col(f"__{name}")) for name, (how, c) in down.items()}).drop(*(f"__{n}" for n in down))
