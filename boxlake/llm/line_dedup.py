"""Line dedup: hashes of lines in range partitions, ordered by document and position inside each key;
first occurrences are streamed by windows, and what comes back for a document is a compressed bitmap.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys
under ``min_points`` code points are never dropped.

A hot key's documents are counted in parts. The frequent keys are a written table of their own when they are
looked up, so that adaptive execution can split the rows of a hot one.

Defined results: a null or empty text is one empty line; very long texts and lines are worked on whole, in
their row; a key counts once for each document, however
often the document has it; rows that repeat doc_id and text are one document when counted and each get
their row back; an empty table gives an empty table; other columns pass ``drop_lines`` unchanged, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.llm.common import LOWER, SPACES, UPPER, as_row, drop_written, read_table, row_key, written

#: Bits in a word of a bitmap (a long, its sign left out) and parts that a hot key's documents are dealt to.
WORD, SALTS = 62, 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def dropped_bitmaps(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep: str = "none") -> DataFrame:
    """doc_id, row_key, dropped map<int,long>: the words of the document's bitmap that have a bit set.

    A line is dropped if its key is in at least min_docs documents; with keep='first' the key's first
    line (smallest doc_id, then position) stays. Keys travel as 128 bits of hash, never as text.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep}")
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).select("doc_id", "row_key", "pos", _key(F.col("line")).alias("key"))
    seen = lines.filter(F.length("key") >= max(1, min_points)).select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    seen = written(seen, "line-hashes")
    once = seen.groupBy("h1", "h2", "doc_id", "row_key").agg(F.min("pos").alias("pos"))
    parts = once.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row_key", "pos")).alias("first"))
    ranged = parts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")  # at most SALTS rows of a key
    key = Window.partitionBy("h1", "h2")
    frequent = (
        ranged.withColumn("docs", F.sum("n").over(key))
        .withColumn("rank", F.row_number().over(key.orderBy("first")))
        .filter((F.col("docs") >= min_docs) & (F.col("rank") == 1))
        .select("h1", "h2", "first")
    )
    frequent = written(frequent, "line-frequent")
    gone = seen.join(frequent, ["h1", "h2"])
    if keep == "first":
        gone = gone.filter(~F.struct("doc_id", "row_key", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy("doc_id", "row_key", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    out = words.groupBy("doc_id", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    out.reads = [seen, frequent]
    return out


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (docs' columns), n_lines and kept, the array of lines that stay, of each row of docs. The tables that the bitmaps
    were made from go when these are written."""
    b = written(bitmaps, "line-bitmaps")
    drop_written(*getattr(bitmaps, "reads", ()))
    packed = docs.select(as_row(docs).alias("row"), "doc_id", row_key("doc_id", "text").alias("row_key"))
    joined = packed.join(b, packed["doc_id"].eqNullSafe(b["doc_id"]) & (packed["row_key"] == b["row_key"]), "left").select("row", "dropped")
    all_lines = lines_of(F.col("row.text"))
    # a word of the bitmap is looked up once for all of its lines; both functions name what is computed once
    stays = lambda bits: lambda x, i: bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0
    part = lambda lines, k, bits: F.when(bits.isNull(), F.slice(lines, k * WORD + 1, F.lit(WORD))).otherwise(F.filter(F.slice(lines, k * WORD + 1, F.lit(WORD)), stays(bits)))
    word = lambda lines: lambda k: _bound(F.try_element_at("dropped", k), lambda bits: part(lines, k, bits))
    left = _bound(all_lines, lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD).cast("int")), word(lines))))
    kept = F.when(F.col("dropped").isNull(), all_lines).otherwise(left)
    return joined.select("row", F.size(all_lines).cast("long").alias("n_lines"), kept.alias("kept"))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep: str = "none") -> DataFrame:
    """docs with the repeated lines taken out of text; all other columns as they were."""
    out = kept_lines(docs, dropped_bitmaps(docs, min_docs, min_points, keep))
    return out.select(*(F.array_join("kept", "\n").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = kept_lines(docs, dropped_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_line_dedup": op6_line_dedup}
ORACLE = {
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
    translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, l.k IN (SELECT k FROM f) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
