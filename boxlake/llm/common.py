"""What the operators of this subpackage share: words, keys, and tables written to the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators mean it: space and the five ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local session (tests) gets a folder of
    its own; on a cluster it is an error, since executors can't read each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="boxlake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/boxlake-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, a lost executor
    costs no recomputation, and the planner knows its size before it chooses a join. The write's own shuffle
    files are of no use to anything else and go when it ends."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` whose readers have all been written themselves."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that none of them meets a column of the operator."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null and blank texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * 6), " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: a word starts where white space (or nothing) goes before."""
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), SPACES, " " * 6))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def row_key(*columns: str) -> Column:
    """Tells rows apart by content where doc_id may repeat or be null."""
    return F.xxhash64(*columns)


def have_library(name: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(name) is not None


def default_tokenizer(name: str) -> str:
    """Path of a public vocabulary file; BOXLAKE_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("BOXLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
