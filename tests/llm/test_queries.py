"""The registered queries of the subpackage against their SQL, and the pipeline."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from boxlake.llm import quality_rules, registry, sentencepiece_codec
from boxlake.llm.common import default_tokenizer, read_table
from test_documents import WORD, brute_components, brute_verdict


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    df = registry.queries()[name](spark, sf_dir)
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(r[columns.index(c)] for c in df.columns)) for r in found.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = driver.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


def brute_times(docs):
    """{doc_id: times taken} of rows by id: sources weigh 5, 2, 1 in order; a target above 3 times its source's size stops
    there. Documents are taken by rising hash; the one at the edge is, if at least half of it fits."""
    size = {d: len(WORD.findall(r.text or "")) for d, r in docs.items()}
    sources = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in sources}
    weight, target, rest = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, sum(size.values())
    while True:
        left = [s for s in sources if s not in target]
        share = rest / (sum(weight[s] for s in left) or 1)
        over = [s for s in left if 3 * of[s] < share * weight[s]]
        if not over:
            break
        target.update({s: 3 * of[s] for s in over})
        rest -= sum(3 * of[s] for s in over)
    target.update({s: share * weight[s] for s in left})
    times = {}
    for s in sources:
        copies = int(target[s] // of[s]) if of[s] else 0
        budget, used = target[s] - copies * of[s], 0
        for d in sorted((d for d in docs if docs[d].source == s), key=lambda d: hashlib.md5(f"{d}:{docs[d].text or ''}".encode()).hexdigest()):
            fits = used + size[d] <= budget or 2 * (budget - used) >= size[d] > 0
            times[d] = copies + (budget > 0 and fits)
            used = used + size[d] if fits else float("inf")
    return times


def test_pipeline(spark, sf_dir):
    """Each stage on the rows that its predecessor kept, against a plain version of it; rows that stay are unchanged."""
    import sentencepiece

    docs = read_table(spark, sf_dir, "documents")
    first, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    rules = quality_rules.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    rows = dict(first)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        got = docs.collect()
        assert docs.columns == columns and all(r == first[r.doc_id] for r in got)
        if name == "quality_rules":
            want = {d: 1 for d, r in rows.items() if brute_verdict(r.text, rules)[1]}
        elif name == "exact_dedup":
            best = {}
            for d, r in sorted(rows.items(), key=lambda x: (-len(x[1].text or ""), x[0])):
                best.setdefault("".join(WORD.findall(r.text or "")), d)
            want = {d: 1 for d in best.values()}
        elif name == "minhash_near_dedup":
            parts = brute_components({d: r.text for d, r in rows.items()}, 5, 80)
            want = {d: 1 for d, (_, root) in parts.items() if d == root}
        else:
            want = {d: n for d, n in brute_times(rows).items() if n}
        assert Counter(r.doc_id for r in got) == want and 0 < len(want) <= len(rows)
        rows = {d: first[d] for d in want}
    library = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == want
    assert all(r.piece_ids == library.encode(first[r.doc_id].text or "") and r.round_trip for r in out)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t, s in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], s).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated ids with equal and other texts, clashing columns, very long texts: only rejected
    documents and copies go, and what stays passes unchanged."""
    from pyspark.sql import functions as F

    text = lambda x, n=80: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (1, text("b"), "en", "s", 1), (None, text("c"), None, None, None), (None, text("d"), "en", "t", 1), (2, text("a") + " ", "en", "s", 1)]
    rows += [(3, text("a", 81), "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "too short", "en", "s", 9), (7, text("long", 30_000), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(1) for c in ("row", "kept", "times", "group", "__row")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        texts = docs if name != "sentencepiece" else sentencepiece_codec.decode(docs)
        kept[name] = {(r.doc_id, r.text.split(" ")[0], len(r.text.split())) for r in texts.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    good = {(1, "a0", 80), (1, "b0", 80), (None, "c0", 80), (None, "d0", 80), (2, "a0", 80), (3, "a0", 81), (7, "long0", 30_000)}
    assert kept["quality_rules"] == good
    assert kept["exact_dedup"] == good - {(1, "a0", 80)}  # of a's copies the one with a blank more stays
    assert kept["minhash_near_dedup"] == good - {(1, "a0", 80), (3, "a0", 81)}
    assert kept["sentencepiece"] == kept["mix_sources"] <= kept["minhash_near_dedup"]
