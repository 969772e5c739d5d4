"""Tables written to the folder that all executors share, where lineage has to end."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Off, rows that are dealt out by some keys of a join are joined where they are.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Files that a task which writes buckets holds open, before it would sort its rows by bucket.
_OPEN = 32


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of its
    own; on a cluster it is an error, since executors can't read each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="boxlake-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/boxlake-{uuid.uuid4().hex}"


def written(df: DataFrame, together: bool = False) -> DataFrame:
    """df written under spark.checkpoint.dir and read again; its shuffle files go when it is written. together: joins on an image and
    more work where the image's rows are, if a table of ``written_in_buckets`` has them so."""
    spark = df.sparkSession
    path = new_folder(spark)
    with _set(spark, **{_CLEAN_UP: "true"}, **({_ALL_KEYS: "false"} if together else {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written_in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written like ``written`` (together), as a table of so many buckets by a key, which its ``buckets`` tell: groupings on the key
    (and more columns) and joins on it find its rows together and deal nothing out again. Rows that come dealt out by the key already
    make a file a bucket."""
    spark = df.sparkSession
    path = new_folder(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    with _set(spark, **{_CLEAN_UP: "true", _ALL_KEYS: "false", "spark.sql.maxConcurrentOutputFileWriters": str(_OPEN)}):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.table, out.buckets = path, name, buckets
    return out


def buckets_of(*tables: DataFrame) -> int | None:
    """Buckets of tables of ``written_in_buckets``, where all have as many."""
    found = {getattr(t, "buckets", None) for t in tables}
    return found.pop() if len(found) == 1 else None


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` when all that reads them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
