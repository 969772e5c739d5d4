"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("exact_dedup", "line_dedup", "mixing", "token_counts", "quality_rules", "warc", "html_text", "sentencepiece_codec", "minhash", "repeats", "collocations", "chat_format", "prefix_trie")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"boxlake.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"boxlake.llm.{m}").ORACLE.items()}
