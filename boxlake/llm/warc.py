"""WARC archives with dictionary compression: written in tasks to the shared folder, read back by Spark.

Each archive file holds up to ``FILE_BYTES`` of records. Its dictionary is made from the records it is
to hold and stands in a leading skippable frame (magic 0x184D2A5D); each record is a Zstandard frame
of its own. Files are named by their task's partition and place in it, written under another name and
then renamed, so a task that runs again replaces its files; what is read back are the manifest's.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id is the
response and the others revisit it. Defined results: a null html is an empty payload; a null url leaves
the target out; rows that repeat the response's page_id are responses as well; a null page_id is
archived without its header and never revisited; a payload of any length is one record; an empty table
gives an empty table; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import new_folder, read_table, written

FILE_BYTES = 24 << 20
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: At most so many bytes of a file's records, spread over them, train its dictionary.
TRAIN_BYTES = 4 << 20
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~\x27')}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one .warc.zst file."""
    import zstandard as z

    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    samples = records[::step]
    try:
        trained = z.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except z.ZstdError:  # too few records to train on: their first bytes serve as they are
        trained = z.ZstdCompressionDict(b"".join(r[:2048] for r in samples[:32])[:DICTIONARY_BYTES], dict_type=z.DICT_TYPE_RAWCONTENT)
    plain = trained.as_bytes()
    packer = z.ZstdCompressor(level=LEVEL, dict_data=trained)
    return b"".join([SKIPPABLE_MAGIC.to_bytes(4, "little"), len(plain).to_bytes(4, "little"), plain, *map(packer.compress, records)])


def records_in(content: bytes) -> Iterator[bytes]:
    """The records of one file, each decompressed alone with the dictionary of the leading frame."""
    import zstandard as z

    if int.from_bytes(content[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    at = 8 + int.from_bytes(content[4:8], "little")
    plain = content[8:at]
    kind = z.DICT_TYPE_FULLDICT if plain[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT
    unpack = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(plain, dict_type=kind))
    view = memoryview(content)
    while at < len(content):
        frame = unpack.decompressobj()
        size = z.frame_content_size(view[at : at + 32])
        out = [frame.decompress(view[at : at + max(1 << 12, size + 256)])]
        taken = min(len(content) - at, max(1 << 12, size + 256))
        while not frame.eof:
            out.append(frame.decompress(view[at + taken : at + taken + (1 << 16)]))
            taken = min(len(content) - at, taken + (1 << 16))
        at += taken - len(frame.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


#: The list of a folder's archives; names that begin so aren't read as archives.
LISTED = "_manifest"


def _writer(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def put(fs, base: str, records: list[bytes], place: int) -> tuple[str, int, int]:
        content, task = archive(records), TaskContext.get()
        # a name that no other attempt of the task has: its rows may come in another order, and only the manifest's files are read
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId():09d}-{place:06d}.warc.zst"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(content)
        fs.move(part, path)
        return path, len(records), len(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        held, size, done = [], 0, []
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(warc_record(page_id, url, (html or "").encode(), refers_to, revisit, date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    done.append(put(fs, base, held, len(done)))
                    held, size = [], 0
        if held:
            done.append(put(fs, base, held, len(done)))
        names = ["path", "n_records", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=names)

    return run


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Equal payloads meet as hashes; only groups of two or more are joined
    back, from a written table, so that adaptive execution can split a payload that many pages have."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    groups = keyed.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    joined = keyed.join(written(groups, "warc-groups"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("page_id").isNotNull()
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under folder, which all executors share; gives a row per file: path, n_records, n_bytes. The list is
    also put into the folder when all are written, so what attempts that failed or earlier writes have left isn't read."""
    typed = with_record_types(pages, min_bytes)
    manifest = written(typed.mapInArrow(_writer(folder, date), "path string, n_records bigint, n_bytes bigint"), "warc-manifest")
    manifest.write.mode("overwrite").parquet(f"{folder}/{LISTED}")
    return manifest


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """A row per record of the archives in folder (of the manifest's, if one is given, else of those that the folder's own list
    has, if there is one); the payload of a response is checked against its digest."""
    if manifest is None:
        listed = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LISTED}")
        if listed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(listed):
            manifest = spark.read.parquet(f"{folder}/{LISTED}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in records_in(content.as_py()):
                    fields, block = parse_record(record)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block[len(HTTP_HEAD) :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                            raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} don't agree")
                    page, to = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                    rows.append((page and int(page), size, digest, fields["WARC-Type"], to and int(to)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        name = lambda c: F.regexp_extract(c, r"[^/]+$", 0)
        files = files.join(manifest.select(name("path").alias("__name")), name("path") == F.col("__name"), "left_semi")
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read_warc(spark, folder, manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_warc": op9_warc}
_BITS = "[CASE substr(h, i, 1) " + " ".join(f"WHEN '{x:X}' THEN '{x:04b}'" for x in range(16)) + " END FOR i IN range(1, 41)]"
ORACLE = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT *, array_to_string({_BITS}, '') AS bits FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1) FOR k IN range(0, 32)], '') AS digest,
  min(page_id) OVER (PARTITION BY html) AS first FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
}
