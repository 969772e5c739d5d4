"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources, in code-point order with null last, weigh
``weights`` in turn and share all sizes; a target stops at ``max_repeats`` times its source's size and
the excess is shared again by weight. A source takes every document floor(target / size) times, and
once more the documents whose hash is under a threshold that fills the rest of its budget. The
threshold is found from sums by source and hash bucket: nested buckets, of which only the one that
holds the budget's edge is opened again. Nothing is sorted, and no source meets in one task.

Defined results: null texts have size 0; very long texts are counted whole; the document at the edge is taken if at least half of it fits;
rows that repeat both doc_id and text share a hash and are taken together, others under one doc_id (or none) have hashes of their
own; an empty table gives an empty table; other columns pass ``mix`` unchanged, whatever their names. The hash depends on
doc_id and text alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.llm.common import as_row, n_words, read_table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bits of the hash, and bits by which each level opens a bucket.
HASH_BITS, LEVEL_BITS = 60, 10


def doc_hash(doc_id: Column, text: Column) -> Column:
    row = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source: source, source_size, target. One row for each source is all that is gathered."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    srcs = written(by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats), "mix-sources")
    total = srcs.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, capped = None, -1
    while True:  # each pass stops at least one more source; a pass reads one row of sums
        over = F.lit(False) if share is None else F.col("cap") < F.lit(share) * F.col("weight")
        n, stopped, w = srcs.agg(F.sum(over.cast("int")), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not w or n == capped:
            break
        capped, share = n, (total - stopped) / w
    share = share or 0.0
    target = F.when(F.col("cap") < F.lit(share) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return written(srcs.select("source", "source_size", target.alias("target")), "mix-targets")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies, threshold: a document is taken copies times, and once more if hash < threshold."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goals.withColumn("copies", whole.cast("long")).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))  # null is a source too
    edge = plan.select(key.alias("k"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"), "budget")
    rest = sized.select(key.alias("k"), "hash", "size")
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        inside = rest if level == 0 else rest.join(edge.select("k", "low", "high"), "k").filter(F.col("hash").between(F.col("low"), F.col("high"))).drop("low", "high")
        inside = inside if level == 0 else written(inside, "mix-edge")
        rest = inside
        hist = inside.groupBy("k", F.expr(f"hash div {width}").alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = Window.partitionBy("k").orderBy("bucket")  # at most 2**LEVEL_BITS rows of a source
        cum = hist.join(edge.select("k", "before", "budget"), "k").withColumn("after", F.col("before") + F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
        at = cum.filter((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("after")))
        edge = written(at.select("k", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("bucket") * width).alias("low"), "high", "before", "budget", "words"), "mix-edges")
        if edge.filter("low < high").isEmpty():
            break
    # each edge is now one value of the hash: take it if at least half of it fits
    last = edge.select("k", F.when(2 * (F.col("budget") - F.col("before")) >= F.col("words"), F.col("low") + 1).otherwise(F.col("low")).alias("found"))
    none_left = F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(0)  # no edge: the budget holds every document
    return plan.withColumn("k", key).join(last, "k", "left").select("source", "source_size", "target", "copies", F.coalesce("found", none_left).cast("long").alias("threshold"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, hash, size, source_size, target, taken, times."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-sized")
    cuts = written(thresholds(sized, targets(sized)), "mix-thresholds").withColumnRenamed("source", "of")
    times = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    joined = sized.join(cuts, sized["source"].eqNullSafe(cuts["of"]))
    return joined.select("doc_id", "source", "hash", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all its columns."""
    plan = written(mix_plan(docs).filter("times > 0").select("doc_id", "source", "hash", F.col("times").cast("int").alias("times")).distinct(), "mix-plan")
    packed = docs.select(as_row(docs).alias("row"), "doc_id", "source", doc_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    joined = packed.join(plan, packed["doc_id"].eqNullSafe(plan["doc_id"]) & packed["source"].eqNullSafe(plan["source"]) & (packed["hash"] == plan["hash"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_mix_sources": op5_mix_sources}
ORACLE = {
    "op5_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s),
r AS (
  SELECT 0 AS k, (SELECT total FROM t) / CAST((SELECT sum(weight) FROM s) AS DOUBLE) AS share
  UNION ALL
  SELECT k + 1, (SELECT ((SELECT total FROM t) - coalesce(sum(cap) FILTER (WHERE cap < r.share * weight), 0))
      / CAST(sum(weight) FILTER (WHERE cap >= r.share * weight) AS DOUBLE) FROM s) FROM r WHERE k < 60),
f AS (SELECT share FROM r ORDER BY k DESC LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN cap < share * weight THEN CAST(cap AS DOUBLE) ELSE share * weight END AS target FROM s, f),
b AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM g),
c AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS after,
    sum(size) OVER (PARTITION BY d.source, hash) AS here
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN budget > 0 AND (after <= budget OR (after - here <= budget AND 2 * (budget - (after - here)) >= here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
}
