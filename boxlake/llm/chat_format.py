r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as
context, and only that reply is trained.

A conversation's formatted text is its turns one after another, each ``### role: text</turn>`` and a line feed. Control strings
inside texts, and the backslash, get a backslash before them (``\\``, ``\###``, ``\</turn>``); roles also have ``~0`` for ``~`` and
``~1`` for ``:``. So turns are told apart by their marks alone and texts come back as they were (``parse``).

An example (``expand``) holds its whole context as a text, its target and the span of its reply. Examples grow with the square of a
conversation's turns, by the method's nature; they are made and read row by row, one context of a task at a time.

A conversation is one stream in the order of its turns: sorted on disk where memory is short, and read row by row.

Defined results: null roles and texts are empty; a null turn comes first, equal turns go by role, then text; repeated rows are turns
of their own; rows without conv_id are one conversation; a conversation without an assistant turn has no example; very long texts
are formatted whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.llm.common import read_table

MARK, END = "###", "</turn>"
TRAINED = "assistant"
_ESCAPED = rf"(\\|{re.escape(MARK)}|{re.escape(END)})"
_TURN = re.compile(rf"(?s){MARK} (.*?): ((?:[^\\<]|\\\\|\\{MARK}|\\{END}|<(?!/turn>))*){END}\n")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPED, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _ESCAPED, "$1")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("~"), F.lit("~0")), F.lit(":"), F.lit("~1"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("~1"), F.lit(":")), F.lit("~0"), F.lit("~")))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a conversation's formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at character {at}")
        back = lambda x: re.sub(r"\\" + _ESCAPED, r"\1", x)
        turns.append((back(found[1].replace("~1", ":").replace("~0", "~")), back(found[2])))
        at = found.end()
    return turns


def format_turns(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, place (from 1), formatted, start, text_start, text_chars, trains of each turn. Places in texts are counted in
    characters from 0: the turn begins at ``start`` of its conversation's formatted text, its own text at ``text_start``."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order).cast("long"))
    head, body = F.concat(F.lit(f"{MARK} "), _role(F.col("role")), F.lit(": ")), escaped(F.col("text"))
    parts = turns.select("conv_id", "turn", "role", "text", "place", head.alias("head"), body.alias("body"))
    start = F.coalesce(F.sum(F.length("formatted").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = parts.withColumn("formatted", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn("start", start)
    return whole.select("conv_id", "place", "formatted", "start", (F.col("start") + F.length("head")).alias("text_start"), F.length("body").cast("long").alias("text_chars"), (F.col("role") == trained).alias("trains"))


def expand(turns: DataFrame, whole: bool = False) -> DataFrame:
    """conv_id, place, context, context_chars, target, reply_start, reply_chars: an example for each turn that trains. Its context is the
    text of all turns before it, which are the first context_chars characters of the conversation's formatted text; the loss counts on its
    reply's span alone. whole: beside formatted, and with a row of nulls for each other turn, so that examples are read in their conversation's order."""
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    context = F.when(F.col("trains"), F.array_join(F.collect_list("formatted").over(before), ""))
    example = {"context_chars": F.col("start"), "target": F.col("formatted"), "reply_start": F.col("text_start"), "reply_chars": F.col("text_chars")}
    turns = turns.withColumn("context", context)
    if whole:
        return turns.select("conv_id", "place", "formatted", "context", *(F.when(F.col("trains"), c).alias(name) for name, c in example.items()))
    return turns.filter("trains").select("conv_id", "place", "context", *(c.alias(name) for name, c in example.items()))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, place, context, target, mask_start, mask_chars: the examples of ``expand``; the mask is a span of context and target together."""
    return expand(turns).select("conv_id", "place", "context", "target", F.col("reply_start").alias("mask_start"), F.col("reply_chars").alias("mask_chars"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each in order and unbroken, to a row a conversation; one row of text is held at a time. An example's
    context must be the text of all turns before it, by its length and its digest."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "context_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    done: list[tuple] = []
    conv, turns, loss, whole, sums = None, None, None, None, [0] * 5

    def close() -> None:
        if turns is not None:
            done.append((conv, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), *sums[2:]))

    for batch in batches:
        for of, role, text, formatted, reply, context, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns is None or of != conv:
                close()
                conv, turns, loss, whole, sums = of, hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), [0] * 5
            turns.update(f"{role}\n{text}\n".encode())
            if reply is not None:
                if context != sums[2]:
                    raise ValueError(f"a context of {context} characters where {sums[2]} came before, in conversation {of}")
                if digest != whole.hexdigest():
                    raise ValueError(f"a context that isn't what came before, in conversation {of}")
                loss.update(reply.encode())
                sums[1] += len(reply)
                sums[3] += 1
                sums[4] += context
            sums[0] += 1
            sums[2] += len(formatted)
            whole.update(formatted.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, context_chars of each conversation, from
    its formatted text and its examples alone: roles and texts by their marks, replies from the examples' targets by the spans of
    the mask, each behind its context's whole text."""
    formatted = F.col("formatted")
    head = F.substring_index(formatted, ": ", 1)
    role = _role_back(F.substring(head, F.lit(len(MARK) + 2), F.length(head)))
    at = F.length(head) + 3
    text = unescaped(F.substring(formatted, at, F.length(formatted) - at - len(END)))
    reply = unescaped(F.substring(F.col("target"), (F.col("reply_start") - F.col("context_chars") + 1).cast("int"), F.col("reply_chars").cast("int")))
    rows = expand(turns, whole=True).select("conv_id", "place", role.alias("role"), text.alias("text"), "formatted", reply.alias("reply"), "context_chars", F.sha2(F.encode("context", "utf-8"), 256).alias("context_sha256"))
    # the windows of format_turns have dealt the rows by conv_id
    ordered = rows.sortWithinPartitions("conv_id", "place").drop("place")
    return ordered.mapInArrow(_digested, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, context_chars bigint")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"\\{MARK} Assistant: {END} ok"
    odd = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, TRAINED, text)], "conv_id bigint, turn bigint, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return read_back(format_turns(rows)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_chat_format": op12_chat_format}
ORACLE = {
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    length(replace(replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), '~', '~0'), ':', '~1'))
      + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
