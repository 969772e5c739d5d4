"""Examples of chats hold their whole contexts, and reading back goes through these."""

import re

import pytest
from pyspark.sql import functions as F

from boxlake.llm import chat_format


def turns_of(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"### {c}: turn {t}</turn> ☃" * (t % 3)) for c in range(5) for t in range(40)]
    return chat_format.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7))


def test_examples_hold_their_contexts(spark):
    turns, text = turns_of(spark), {}
    for r in turns.orderBy("conv_id", "place").collect():
        text[r.conv_id] = text.get(r.conv_id, "") + r.formatted
    found = chat_format.expand(turns).collect()
    assert len(found) == 5 * 20
    for r in found:
        assert len(r.context) == r.context_chars and text[r.conv_id].startswith(r.context + r.target)
        assert (r.context + r.target)[r.reply_start : r.reply_start + r.reply_chars] == re.sub(r"(###|</turn>)", r"\\\1", chat_format.parse(r.target)[0][1])


def test_a_context_of_other_text_is_an_error(spark, monkeypatch):
    turns, expand = turns_of(spark), chat_format.expand
    assert {r.n_examples for r in chat_format.read_back(turns).collect()} == {20}
    monkeypatch.setattr(chat_format, "expand", lambda t, whole=False: expand(t, whole).withColumn("context", F.translate("context", "u", "v")))
    with pytest.raises(Exception, match="isn't what came before"):
        chat_format.read_back(turns).collect()
