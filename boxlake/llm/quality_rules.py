"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of a text are Spark expressions alone. The learner grows conjunctions of thresholds on
ratios of them by FOIL gain against documents labelled 0, prunes them on rows held out, and emits one
ordered conditional expression (``when(rule, false)... otherwise(true)``). It reads a sample of labelled
rows bounded by ``FIT_ROWS`` (those whose id has the smallest hash); everything else covers all data.

Defined results: a null or blank text has no words and fails the base rules; very long texts are measured
whole, in their row; an id labelled more than
once counts with its lowest label; without labels of both kinds the list is empty and the base rules
decide alone; rows that repeat are all judged; an empty table gives an empty table; ``apply_rules``
keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import LOWER, SPACES, UPPER, as_row, read_table, words_of, written

#: At most so many labelled rows are fitted on; a third of them only prune.
FIT_ROWS = 12_000
SYMBOLS = "#*$%&|<>"
MAX_LITERALS, MAX_RULES, QUANTILES = 3, 24, 32
#: A rule stays if it is right on this share of the rows held out, and on as many rows at least.
LEAST_PRECISION, LEAST_ROWS = 0.95, 3

#: Ratios the rules test, per 1,000: names and expressions over the statistics.
RATIOS = {
    "symbols": "1000 * n_symbols / n_chars",
    "pipes": "1000 * n_pipes / n_words",
    "capitals": "1000 * n_upper / n_chars",
    "marks": "1000 * n_marks / n_words",
    "digits": "1000 * n_digits / n_chars",
    "word_length": "1000 * word_chars / n_words",
    "repeats": "1000 * n_repeat_words / n_words",
    "dup_lines": "1000 * n_dup_lines / n_lines",
    "words": "n_words * 1.0D",
}


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id by default) and the statistics of each whole text; n_repeat_words counts words in
    3-word windows that the text has twice or more, found by sorting the windows' hashes in the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select(*(keep or ["doc_id"]), text.alias("__t"), words_of(text).alias("__w"))
    hashed = with_words.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    n = F.size("__h")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)).alias("h"), i.alias("i"))))
    ordered = hashed.withColumn("__s", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    again = F.filter("__s", lambda x, k: (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"]))
    flagged = ordered.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("__p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    full_lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    lined = flagged.withColumn("__l", full_lines)
    found = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("__t"), SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.length("__t").cast("long").alias("n_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        _count(F.col("__t"), "|").alias("n_pipes"),
        _count(F.col("__t"), UPPER).alias("n_upper"),
        _count(F.col("__t"), "!?").alias("n_marks"),
        _count(F.col("__t"), "0123456789").alias("n_digits"),
    )
    # a generator of one row: the optimizer moves no filter below it, where each use would compute all this again
    return lined.select(*(keep or ["doc_id"]), F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    ratio: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.ratio])
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, value: float) -> bool:
        return (value > self.threshold) == self.above


Rule = tuple[Literal, ...]


def learn_rules(rows: list[tuple[list[float], bool]]) -> list[Rule]:
    """Sequential covering over (ratios in the order of RATIOS, is bad): rules for bad rows, in order.

    Sets of rows are the bits of integers, so a candidate costs two conjunctions and two counts.
    """
    import math
    from bisect import bisect_left

    if len({bad for _, bad in rows}) < 2:
        return []
    literals: list[tuple[Literal, int]] = []
    for k, name in enumerate(RATIOS):
        values = sorted(r[0][k] for r in rows)
        bad = sorted(r[0][k] for r in rows if r[1])
        at = {v[min(len(v) - 1, q * len(v) // QUANTILES)] for v in (values, bad) for q in range(QUANTILES)}
        ends = sorted(set(values))
        # a threshold lies midway between two neighbouring values
        for cut in sorted({(ends[i] + ends[min(i + 1, len(ends) - 1)]) / 2 for x in at for i in (bisect_left(ends, x), max(bisect_left(ends, x) - 1, 0))}):
            above = sum(1 << i for i, r in enumerate(rows) if r[0][k] > cut) if len(rows) < 64 else int("".join("1" if r[0][k] > cut else "0" for r in reversed(rows)), 2)
            literals.append((Literal(name, True, cut), above))
            literals.append((Literal(name, False, cut), ((1 << len(rows)) - 1) & ~above))
    is_bad = sum(1 << i for i, r in enumerate(rows) if r[1])
    held = sum(1 << i for i in range(2, len(rows), 3))  # rows come in the order of a hash
    left, rules = (1 << len(rows)) - 1, []
    right = lambda p, n: (p + 1) / (p + n + 2)
    while len(rules) < MAX_RULES and (left & is_bad & ~held):
        covers, rule = left & ~held, []
        while len(rule) < MAX_LITERALS and covers & ~is_bad:
            p, n = (covers & is_bad).bit_count(), (covers & ~is_bad).bit_count()
            now = math.log2(p / (p + n))
            best, gain = None, 0.0
            for lit, rows_of in literals:
                inside = covers & rows_of
                q = (inside & is_bad).bit_count()
                if q and (g := q * (math.log2(q / inside.bit_count()) - now)) > gain + 1e-9:
                    best, gain = (lit, rows_of), g
            if best is None:
                break
            rule.append(best)
            covers &= best[1]

        def held_score(parts: list[tuple[Literal, int]]) -> tuple[float, int, int]:
            inside = left & held
            for _, rows_of in parts:
                inside &= rows_of
            p, n = (inside & is_bad).bit_count(), (inside & ~is_bad).bit_count()  # noqa: B023
            return right(p, n), p, n

        while len(rule) > 1 and held_score(rule[:-1])[0] >= held_score(rule)[0]:
            rule.pop()
        if not rule:
            break
        _, p, n = held_score(rule)
        inside = left
        for _, rows_of in rule:
            inside &= rows_of
        all_p, all_n = (inside & is_bad).bit_count(), (inside & ~is_bad).bit_count()
        if all_p < LEAST_ROWS or all_p < LEAST_PRECISION * (all_p + all_n) or p < LEAST_PRECISION * (p + n):
            break
        rules.append(tuple(lit for lit, _ in rule))
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects, else the text is kept."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        cond = rule[0].column()
        for lit in rule[1:]:
            cond = cond & lit.column()
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from the statistics of at most fit_rows labelled documents that pass the base rules."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "quality-sample")
    stats = text_statistics(docs.select("doc_id", "text").join(sample, "doc_id"), ["doc_id", "quality"])
    ratios = F.struct(*(F.expr(x).cast("double").alias(k) for k, x in RATIOS.items()))
    by_id = stats.filter(~base_failed()).groupBy("doc_id", "quality").agg(F.min(ratios).alias("ratios"))  # a row per label
    rows = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return learn_rules([(list(r["ratios"]), r["quality"] == 0) for r in rows])


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns."""
    packed = docs.select(as_row(docs).alias("row"), F.col("text"))
    return text_statistics(packed, ["row"]).filter(verdict(rules)).select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    stats = text_statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(fit_rules(docs, labels)).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
