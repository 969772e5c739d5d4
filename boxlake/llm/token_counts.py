"""Token counts: batches of texts encoded in Arrow functions that return lengths only.

A batch holds at most ``BATCH_BYTES`` of text. Texts are cut at safe boundaries, a single space between
two characters that aren't white space: there the tokenizer's own pre-tokenizer always cuts, so the
pieces' tokens are the whole text's. Equal pieces are encoded once in a task, as far as the memory
bound for remembered lengths allows. No special tokens are added; special strings in texts are treated
as the library does by default; nothing is truncated or padded.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts with no safe boundary are encoded
whole, however long; rows that repeat are all counted; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from boxlake.llm.common import default_tokenizer, read_table
from boxlake.llm.hashing import slices_of

BATCH_BYTES = 1 << 20
#: Pieces whose number of tokens a task remembers before it starts anew, and the longest (in characters) that it does remember.
REMEMBERED, SHORT = 400_000, 64
LIMIT = 512
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85​﻿]) (?=[^\s\x1c-\x1f\x85​﻿])")
_UNSAFE = re.compile(r"^ | $|[\s\x1c-\x1f\x85​﻿] | [\s\x1c-\x1f\x85​﻿]")


def pieces_of(text: str) -> list[str]:
    """text cut before each safe space; all pieces but the first begin with that space."""
    cut = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
    return [cut[0], *[" " + x for x in cut[1:]]]


def token_counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: (doc_id, text) to (doc_id, n_bytes, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, int] = {}

        def lengths(texts: list[str]) -> list[int]:
            cut = [pieces_of(t) for t in texts]
            new = list({p for pieces in cut for p in pieces if p not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({p for pieces in cut for p in pieces})
            long: dict[str, int] = {}  # of this batch alone
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                for piece, tokens in zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True):
                    (known if len(piece) <= SHORT else long)[piece] = tokens
            return [sum(known[p] if p in known else long[p] for p in pieces) for pieces in cut]

        for batch in batches:
            for part in slices_of(batch, 1, BATCH_BYTES):
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                tokens = lengths([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; path is a tokenizers .json file every executor has."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(token_counter(path or default_tokenizer("byte_bpe_50k.json")), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
