"""Exact dedup by progressive refinement: length, then a prefix's hash, then the hash of the whole text.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``. Of equal texts the row
with the most code points in the original stays, then the smallest doc_id (a null id sorts first).

What is looked up by a key that many rows may share (a length, a hash) is a written table of its own, so
that adaptive execution can split the rows of a hot key; groupings are counts and minima, combined before
their shuffle.

Defined results: a null text counts as empty and equals every blank text; very long texts are compared
whole, by SHA-256; an empty table gives an empty table; rows that repeat doc_id and text all count in group_size and share the verdict (``drop_copies``
keeps one of them, the same in every run); rows whose texts differ all stay, whether their doc_id is null,
repeated or their own; other columns may have any name and pass ``drop_copies`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import SPACES, as_row, drop_written, read_table, written

PREFIX_CHARS = 256


def duplicate_groups(docs: DataFrame, digest: bool = False) -> DataFrame:
    """A row per document: doc_id, n_points, keep_id, group_size, kept, text_sha256.

    The first two levels carry only lengths and hashes. The third hashes the text of rows that share
    both with another row; text_sha256 is null for the others unless digest is set. Groups of copies
    are only ever counts and minima, combined before the shuffle, so no group meets in one task.
    """
    return _groups(docs, digest).select("doc_id", "n_points", "keep_id", "group_size", "kept", "text_sha256")


def _groups(docs: DataFrame, digest: bool = False, survivors_hash: bool = False) -> DataFrame:
    """The columns of duplicate_groups; with survivors_hash also text_hash, the hash of the text as it is, of rows whose length
    and prefix another row shares."""
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACES, "")
    keyed = docs.select(
        F.col("doc_id"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_points"),
        norm.alias("norm"),
        "text",
    ).select(
        "doc_id",
        "n_points",
        F.octet_length("norm").alias("n_norm"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"),
        "norm",
        "text",
    )
    more = [F.when(F.col("shared"), F.xxhash64("text")).alias("text_hash")] if survivors_hash else []
    names = ["text_hash"] if survivors_hash else []
    light = written(keyed.select("n_norm", "prefix_hash"), "exact-keys")
    lengths = written(light.groupBy("n_norm").count().filter("count > 1").select("n_norm"), "exact-lengths")
    same_length = written(light.join(lengths, "n_norm", "left_semi"), "exact-same-length")
    by_prefix = same_length.groupBy("n_norm", "prefix_hash").count().filter("count > 1").select("n_norm", "prefix_hash", F.lit(True).alias("shared"))
    survivors = written(by_prefix, "exact-survivors")
    drop_written(light, lengths, same_length)
    whole = F.sha2(F.col("norm"), 256)
    tagged = written(
        keyed.join(survivors, ["n_norm", "prefix_hash"], "left").select(
            "doc_id",
            "n_points",
            F.coalesce("shared", F.lit(False)).alias("shared"),
            (whole if digest else F.when(F.col("shared"), whole)).alias("text_sha256"),
            *more,
        ),
        "exact-tagged",
    )
    drop_written(survivors)
    groups = (
        tagged.filter("shared")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_points")).alias("p"), "doc_id")).alias("best"))
        .filter("group_size > 1")
    )
    groups = written(groups, "exact-groups")
    return tagged.join(groups, "text_sha256", "left").select(
        "doc_id",
        "n_points",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == -F.col("best.p")))).alias("kept"),
        "text_sha256",
        *names,
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each text.

    Rows are told by doc_id, length and hash of the text as it is. Those that go are dropped; of a group's rows
    that share the verdict to stay one is taken by the least hash of its columns.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    found = written(_groups(docs, False, survivors_hash=True).filter("group_size > 1"), "exact-found")
    rows = found.groupBy("doc_id", "n_points", "text_hash", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    rows = written(rows, "exact-rows")
    several = rows.filter("kept").groupBy("text_sha256").agg(F.sum("n").alias("n")).filter("n > 1").select("text_sha256", F.lit(True).alias("several"))
    several = written(several, "exact-several")
    marked = rows.join(several, "text_sha256", "left").filter("several OR NOT kept")
    marked = marked.select("doc_id", "n_points", "text_hash", F.when(F.col("kept"), F.col("text_sha256")).alias("group"))
    marked = written(marked, "exact-marked")
    drop_written(found, rows, several)
    packed = docs.select(as_row(docs).alias("row"), "doc_id", F.length(text).alias("n_points"), F.xxhash64("text").alias("text_hash"))
    same = packed["doc_id"].eqNullSafe(marked["doc_id"]) & (packed["n_points"] == marked["n_points"]) & (packed["text_hash"] == marked["text_hash"])
    out = packed.join(marked, same, "left_anti").select("row.*")
    repeated = marked.filter("group IS NOT NULL")
    if repeated.isEmpty():
        return out
    hashed = F.xxhash64(*(F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    groups = packed.join(repeated, same).select("group", "row", hashed.alias("order"))
    return out.unionByName(groups.groupBy("group").agg(F.min_by("row", "order").alias("row")).select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_groups(read_table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
  sha256(norm) AS text_sha256
FROM n""",
}
