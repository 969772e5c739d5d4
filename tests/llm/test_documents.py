"""Operators on documents: edge cases, and results against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from boxlake.llm import exact_dedup, line_dedup, minhash, mixing, quality_rules, repeats, sentencepiece_codec, token_counts
from boxlake.llm.common import default_tokenizer, read_table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [None, "", " \n\t ", "one", "two words", "a b c", "naïve  ☃\n\tq x\x00y", "日本語テキスト\n" * 3, "x" * 5000, LONG, LONG + " end", "same line\nsame line\nother", "A B C D E F", "a b c d e f"]


def frame(spark, texts, sources=None, start=0, partitions=3):
    rows = [(start + i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD + ODD[:6] + [LONG])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """Extra columns under names that the operators use inside."""

    return odd.withColumns({c: F.lit(1) for c in ("count", "n", "key", "bucket", "doc", "size", "hash", "uid", "first", "word", "value", "line", "pos", "row_key", "kept", "row", "group", "order", "times", "of", "gone", "dropped", "n_points", "text_hash", "node", "h1", "__t", "__row", "__times", "__copy", "__dropped", "__key", "__gone", "__id", "a b.c")})


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# exact dedup


def test_exact_groups(spark, odd):
    rows = exact_dedup.duplicate_groups(odd, digest=True).collect()
    docs = texts_of(odd)
    groups = defaultdict(list)
    for d, t in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(d)
    assert len(rows) == len(docs)
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", docs[r.doc_id] or "")
        best = min(groups[norm], key=lambda d: (-len(docs[d] or ""), d))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(groups[norm]), r.doc_id == best, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_keeps_columns_and_repeats(spark, clashing, empty):
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == exact_dedup.duplicate_groups(clashing).filter("kept").count()
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    twice = frame(spark, ["a b", "c"]).union(frame(spark, ["a b", "c"]))
    assert {(r.doc_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(twice).collect()} == {(0, 2, True), (1, 2, True)}
    assert exact_dedup.drop_copies(twice).count() == 2
    nulls = spark.createDataFrame([(None, "a", "en", "s", 1), (3, "a", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in exact_dedup.duplicate_groups(nulls).filter("kept").collect()] == [None]


def test_exact_drops_only_copies_where_ids_are_null_or_repeat(spark):
    rows = [(None, "a b", "s"), (None, "c", "s"), (None, "c", "t"), (None, None, "s"), (None, "", "s"), (None, "d", "s")]
    rows += [(5, "ef", "s"), (5, "gh", "s"), (5, "ij", "s"), (5, "ij", "s"), (4, "gh", "s"), (7, "a  b", "s"), (8, "k l", "s"), (8, "kl ", "s"), (8, "kl", "s")]
    docs = spark.createDataFrame([(d, t, "en", x, len(t or "")) for d, t, x in rows], SCHEMA)
    out = [sorted(((r.doc_id, r.text, r.source) for r in exact_dedup.drop_copies(docs.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert out[0] == out[1]
    assert sorted(re.sub(" ", "", t or "") for _, t, _ in out[0]) == ["", "ab", "c", "d", "ef", "gh", "ij", "kl"]
    assert {(4, "gh"), (5, "ef"), (5, "ij"), (7, "a  b"), (None, "d")} <= {(d, t) for d, t, _ in out[0]}


# line dedup


def brute_lines(docs, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    hot = {k for k, v in seen.items() if k and len(v) >= min_docs}
    return {d: [x for x in (t or "").split("\n") if key(x) not in hot] for d, t in docs.items()}


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_against_brute_force(spark, clashing, empty, min_docs):
    rng = random.Random(5)
    pool = ["Menu", " menu\t", "a", "", "  ", "Ärger", "ärger", "x|y"] + [f"l{i}" for i in range(30)]
    docs = frame(spark, ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(12)] + [None, ""])
    want = brute_lines(texts_of(docs), min_docs)
    assert texts_of(line_dedup.drop_lines(docs, min_docs)) == {d: "\n".join(v) for d, v in want.items()}
    out = line_dedup.drop_lines(clashing, min_docs)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert line_dedup.drop_lines(empty).count() == 0


def test_first_line_may_stay(spark):
    docs = frame(spark, ["b\na", "a\nc\na", "A "])
    assert texts_of(line_dedup.drop_lines(docs, 2, keep="first")) == {0: "b\na", 1: "c", 2: ""}
    with pytest.raises(ValueError):
        line_dedup.dropped_bitmaps(docs, keep="last")


# mixing


def test_mix(spark, clashing, empty):
    rng = random.Random(1)
    sources = [rng.choice(["big", "big", "big", "mid", "tiny", None, "É"]) for _ in range(400)]
    docs = frame(spark, ["w " * rng.randint(0, 60) for _ in sources], sources)
    rows = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < share * weight[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: share * weight[s] for s in free}
    taken, most = Counter(), Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_plan(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_plan(empty).count() == 0
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == sum(r.times for r in mixing.mix_plan(clashing).collect())


# token counts


def test_tokens_are_the_library_s(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'s", "9", "é", " ", " ", "\x1c", "\x85", "☃", "<|endoftext|>", "!", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    docs = frame(spark, texts)
    for r in token_counts.token_counts(docs).collect():
        text = texts[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(empty).count() == 0
    assert "".join(token_counts.pieces_of(LONG)) == LONG and len(token_counts.pieces_of(LONG)) == 30_000


# quality rules


def brute_statistics(text):
    words = WORD.findall(text or "")
    triples = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(triples), set()
    for i, x in enumerate(triples):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark, odd):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + "\n#x|" for _ in range(60)]
    for r in quality_rules.text_statistics(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id]), texts[r.doc_id]


def test_rules_are_learned_and_hold_on_other_rows(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    rules = quality_rules.fit_rules(docs, labels.filter("doc_id % 2 = 0"))
    assert rules and all(len(r) <= quality_rules.MAX_LITERALS for r in rules)
    judged = quality_rules.text_statistics(docs).select("doc_id", quality_rules.verdict(rules).alias("kept"), quality_rules.base_failed().alias("base"))
    rows = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in rows)


def test_rules_without_labels_and_columns(spark, clashing, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_rules.fit_rules(clashing, none) == []
    kept = quality_rules.apply_rules(clashing, [])
    assert kept.columns == clashing.columns and {r.text for r in kept.collect()} == {LONG, LONG + " end"}
    assert quality_rules.apply_rules(empty, []).count() == 0
    rows = [([float(i), *[0.0] * 8], i >= 50) for i in range(100)]
    assert quality_rules.learn_rules(rows) == [(quality_rules.Literal("symbols", True, 49.5),)]
    assert quality_rules.learn_rules([([0.0] * 9, True)] * 5) == []


def brute_verdict(text, rules):
    t = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_statistics(t)
    if n_words < 50 or 100 * n_repeat_words > 50 * n_words:
        return True, False
    lines = [x for x in t.split("\n") if WORD.search(x)]
    of = lambda chars: sum(t.count(c) for c in chars)
    value = {
        "symbols": n_symbols / len(t), "pipes": of("|") / n_words, "capitals": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(t), "marks": of("!?") / n_words, "digits": of("0123456789") / len(t),
        "word_length": word_chars / n_words, "repeats": n_repeat_words / n_words, "dup_lines": n_dup_lines / len(lines), "words": n_words / 1000,
    }
    return False, not any(all((1000 * value[x.ratio] > x.threshold) == x.above for x in rule) for rule in rules)


def test_query_of_rules_against_brute_force(spark, sf_dir):
    """Statistics, base rules and the list's verdict on every document, the list walked in plain Python."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rules = quality_rules.fit_rules(docs, labels)
    texts = texts_of(docs)
    rows = quality_rules.op3_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])
        assert (r.base_failed, r.kept) == brute_verdict(texts[r.doc_id], rules)


def test_a_repeated_id_is_fitted_on_once(spark, monkeypatch):
    texts = [(i % 4, " ".join(f"w{i}x{k}" for k in range(60)) + "#" * i) for i in range(80)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], SCHEMA)
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(8)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda rows: seen.append(rows) or [])
    for n in (1, 5):
        quality_rules.fit_rules(docs.repartition(n), labels, fit_rows=8)
    quality_rules.fit_rules(docs.withColumn("quality", F.lit(7)), labels.withColumn("text", F.lit("label")), fit_rows=8)  # names of the other table
    assert seen[2] == seen[0]
    assert len(seen[0]) == 4 and seen[0] == seen[1] and sum(bad for _, bad in seen[0]) == 2


# SentencePiece


def test_pieces_are_the_library_s(spark, empty):
    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    alphabet = ["a", "the", "B", " ", "   ", "\n", "é", "☃", "日", "🙂", "<s>", "▁", "0x", "́", "ing", "qu"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    encoded = sentencepiece_codec.encode(frame(spark, texts))
    for r in encoded.collect():
        assert r.piece_ids == library.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.n_pieces == len(r.piece_ids) and r.round_trip == ("▁" not in (texts[r.doc_id] or ""))
    back = texts_of(sentencepiece_codec.decode(encoded))
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert sentencepiece_codec.encode(empty).count() == 0
    pieces = sentencepiece_codec.load(path)
    for _ in range(200):
        ids = [rng.randrange(3, 600) for _ in range(rng.randint(1, 6))]
        assert pieces.decode(ids) == library.decode(ids)


def test_unigram_states_are_viterbi():
    rng = random.Random(6)
    vocabulary = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if "▁" not in p[1:]}
    table = [("<unk>", 0.0, sentencepiece_codec.UNKNOWN)] + [(p, -rng.random() * 3 - 1, sentencepiece_codec.NORMAL) for p in sorted(vocabulary) if len(p) == 1 or rng.random() < 0.7]
    model = sentencepiece_codec.Pieces(table, sentencepiece_codec.UNIGRAM, False)

    def best(word):
        score = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 3), end):
                piece = word[start:end]
                if piece in model.score:
                    score[end] = max(score[end], score[start] + model.score[piece])
            score[end] = max(score[end], score[end - 1] + model.least)
        return score[-1]

    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(200)})
    for word, ids in model.encode_sorted(words):
        total = sum(table[i][1] if i else model.least for i in ids)
        assert total == pytest.approx(best(word))


# near-dedup


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("seed,edits", [(1, 3), (2, 12), (3, 25)])
def test_components_against_brute_force(spark, seed, edits):
    """Families of copies around the threshold, chains among them, short words that make edits collide."""
    rng = random.Random(seed)
    docs = []
    for _ in range(4):
        base = [f"w{rng.randrange(60)}" for _ in range(120)]
        for _ in range(35):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(copy))
                if rng.random() < 0.4:
                    del copy[at]
                else:
                    copy[at] = f"e{rng.randrange(3)}"
            docs.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    docs += [None, "", "a", "a", "A B", "a b", docs[0].upper(), docs[1] + "\n"]
    frame_ = frame(spark, docs)
    want = brute_components(texts_of(frame_), 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame_, 4, 0.8).collect()}
    assert got == want


def test_near_edges(spark, clashing, empty):
    out = minhash.drop_near_copies(clashing)
    assert out.columns == clashing.columns
    want = brute_components(texts_of(clashing), 5, 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert minhash.near_duplicates(empty).count() == 0
    both = spark.createDataFrame([(2, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "u v w x y z", "en", "s", 1), (5, "u v w x y z", "en", "s", 1)], SCHEMA)
    assert sorted(map(tuple, minhash.near_duplicates(both).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 2, True), (5, 2, 2, False)]
    nulls = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1)], SCHEMA)
    assert sorted(map(tuple, minhash.near_duplicates(nulls).collect()), key=str) == [(3, 2, 3, True), (3, 2, 3, True), (None, 2, None, True)]


def test_near_copies_of_a_repeated_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "xy")
    rows = [(1, one), (3, one), (3, two), (4, two + " more"), (4, "other words that stand alone here"), (None, one), (None, two)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    out = minhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_star_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.root for r in minhash.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


# repeated byte strings


def brute_removed(docs, length):
    seen, out = set(), {}
    for d in sorted(docs):
        t = (docs[d] or "").encode()
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        n_spans = sum(1 for _ in re.finditer(b"\1+", bytes(cover)))
        out[d] = (sum(cover), n_spans, hashlib.sha256(bytes(x for x, c in zip(t, cover) if not c)).hexdigest())
    return out


def repeats_of(docs, *parameters):
    """The operator's results in the form of brute_removed."""
    texts = texts_of(docs)
    keys = {r.h1: r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) h1").collect()}
    rows = repeats.repeated_spans(docs, *parameters).collect()
    assert all(r.n_removed == sum(r.stops) - sum(r.starts) and r.n_spans == len(r.starts) == len(r.stops) for r in rows)
    found = {keys[r.h1]: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(found) == len(rows)
    return {d: found.get(d, (0, 0, hashlib.sha256((t or "").encode()).hexdigest())) for d, t in texts.items()}


@pytest.mark.parametrize("hot", [2, 10_000])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(9)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    docs = frame(spark, [None, "", "a" * 400] + ["".join(rng.choice(passage)[rng.randint(0, 9) :] + rng.choice("xyz") for _ in range(rng.randint(1, 6))) for _ in range(60)])
    want = brute_removed(texts_of(docs), 40)
    assert repeats_of(docs, 40, 16, hot) == want


def test_no_index_holds_a_hot_shard(spark, monkeypatch):
    """Varied text right before and after one shared passage: as many distinct stretches as documents."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(60)
    docs = frame(spark, [word(50) + passage + word(50) for _ in range(120)])
    want = brute_removed(texts_of(docs), 40)
    index = repeats._index

    def bounded(length):
        run, limit = index(length), 16

        def checked(batches):
            count = {}

            def counted():
                for batch in batches:
                    for shard in batch.column(3).to_pylist():
                        count[shard] = count.get(shard, 0) + 1
                        if count[shard] >= limit:
                            raise ValueError("a hot shard in one index")
                    yield batch

            yield from run(counted())

        return checked

    monkeypatch.setattr(repeats, "_index", bounded)
    assert repeats_of(docs, 40, 16, 16) == want and sum(x[0] > 0 for x in want.values()) == 119


def test_query_against_brute_force(spark, sf_dir):
    docs = texts_of(read_table(spark, sf_dir, "documents"))
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_removed(docs, 100) and any(n for _, n, _ in got.values())


def test_index_against_brute_force():
    rng = random.Random(10)
    for _ in range(40):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))) for _ in range(4)]
        texts = [t for t in dict.fromkeys(b"".join(rng.choice(base)[rng.randint(0, 8) :] for _ in range(rng.randint(1, 3))) + bytes([rng.choice(b"abc")]) for _ in range(rng.randint(1, 9))) if len(t) >= 12]
        if not texts:
            continue
        seen = set()
        for t, flags in zip(texts, repeats.repeated_starts(texts, [(i, 0) for i in range(len(texts))], 12), strict=True):
            want = []
            for i in range(len(t) - 11):
                want.append(t[i : i + 12] in seen)
                seen.add(t[i : i + 12])
            assert flags.tolist() == want


def test_repeats_edges(spark, clashing, empty):
    assert repeats.repeated_spans(empty).count() == 0
    assert repeats.repeated_spans(clashing).filter("n_removed > 0").count() >= 1
    more = clashing.selectExpr("doc_id", "text", *(f"1 AS {c}" for c in ("h1", "h2", "gram", "place", "starts", "body")))
    assert repeats.repeated_spans(more).count() == repeats.repeated_spans(clashing).count()
    named = clashing.withColumn("doc_id", clashing["doc_id"].cast("string"))
    assert repeats.repeated_spans(named.union(named)).count() == repeats.repeated_spans(named).count() >= 1
    with pytest.raises(ValueError):
        repeats.repeated_spans(empty, 100, 4)
    starts, counts = repeats.place_keys(np.array([5 << 25 | 3 << 13 | 7 << 1]))
    assert (starts.tolist(), counts.tolist()) == ([5], [8])


@pytest.mark.parametrize("ids", ["none", "third", "same"])
def test_mix_comes_near_its_targets_without_ids(spark, ids):
    """Rows under one doc_id, or none, are told apart by their texts: each source's words come within half of its largest document."""
    rng = random.Random(17)
    rows = [({"none": None, "third": None if i % 3 else i, "same": 5}[ids], " ".join(f"w{rng.random()}" for _ in range(rng.randint(1, 60))), "en", f"s{i % 4 // 2}", 0) for i in range(600)]
    got = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(3)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= r.most / 2 + 1 for r in got)
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("source", F.size(F.split("text", " ")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in mixed} == {r.source: r.taken for r in got}


def test_lines_of_a_very_long_document(spark):
    """Every line's bit is read from its own word: 100,000 lines, a third of them in ten documents."""
    common = [f"common {i}" for i in range(7)]
    long = "\n".join(common[i % 7] if i % 3 == 0 else f"own {i}" for i in range(100_000))
    docs = frame(spark, [long] + ["\n".join(common)] * 10)
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).select("doc_id", "text").collect()}
    assert out[0] == "\n".join(x for x in long.split("\n") if x.startswith("own")) and {out[i] for i in range(1, 11)} == {""}


def test_signatures_reject_only_clear_misses():
    rng = np.random.default_rng(3)
    seeds = minhash._SEEDS
    least = minhash.least_agreement(0.8, 128)
    assert 80 <= least <= 100
    sign = lambda s: np.array(minhash.signature(minhash.minima(s, seeds[:128] | np.uint64(1), seeds[128:])))
    agree = lambda a, b: 128 - sum(int(x).bit_count() for x in (sign(a) ^ sign(b)).view(np.uint64))
    for n in (5, 60, 900):
        for _ in range(40):
            both, more = rng.integers(0, 1 << 63, 8 * n).astype(np.uint64), rng.integers(0, 1 << 63, 4 * n).astype(np.uint64)
            assert agree(np.append(both, more[:n]), np.append(both, more[n : 2 * n])) >= least  # similarity 0.8
            assert agree(more[: 2 * n], more[2 * n :]) < least  # nothing in common


def test_long_words_are_not_remembered():
    pieces = sentencepiece_codec.load(default_tokenizer("piece_bpe_32k.model"))
    long = "漢字" * 3000
    first = pieces.encode([f"short {long} words", long])
    assert first == pieces.encode([f"short {long} words", long]) and all(len(w) <= sentencepiece_codec.SHORT for w in pieces.known) and pieces.known
