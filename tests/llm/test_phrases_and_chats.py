"""Phrases, chat formatting and the prefix trie: edge cases, and results against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from boxlake.llm import chat_format, collocations, prefix_trie
from boxlake.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CHATS = "conv_id bigint, turn bigint, role string, text string"


# phrases


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_counts(docs, longest):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    return f, n


def brute_phrases(docs, min_count, longest, top, percent=100):
    counts, total = brute_counts(docs, longest)
    out = set()
    for lang, f in counts.items():
        found = [p for p in f if len(p) > 1 and f[p] >= min_count]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p in found:
            if any(len(q) > len(p) and 100 * f[q] >= percent * f[p] and inside(p, q) for q in found):
                continue
            s, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def chatter(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "SAT", "on", "a", "mat", "naïve", "☃", "x\u00a0y", "ÄB", "äb"]
    fixed = ["to be or not to be", "terms and conditions of use apply to you", "one two"]
    mark = [" ", " ", "  ", "\t", " \t", ". ", ",", "\n", "\r\n", "!?", " ; ", "\x0b", "\x0c"]
    return [("".join(rng.choice(words + fixed) + rng.choice(mark) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("longest, min_count, percent", [(5, 3, 100), (3, 2, 100), (2, 2, 100), (5, 4, 70), (7, 3, 100)])
def test_phrases(spark, longest, min_count, percent):
    docs = chatter(longest, 150) + [(None, "en"), ("", None), (" .\t", "de"), ("word", "fr"), ("the cat " * 3000, "en")]
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int").withColumns({c: F.lit(1) for c in ("gram", "words", "total", "a", "rank")}).repartition(3)
    found = collocations.collocations(df, min_count, longest, 40, percent, sieve_bits=16)
    assert {tuple(r) for r in found.collect()} == brute_phrases(docs, min_count, longest, 40, percent)


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    """With next to no buckets everything goes through, with many next to nothing does; flows of min_count and more agree."""
    docs = chatter(9, 200)
    df = spark.createDataFrame(docs, "text string, lang string")
    f, _ = brute_counts(docs, 5)
    want = {(lang, " ".join(p), n) for lang, c in f.items() for p, n in c.items() if n >= 5}
    for bits in (16, 26):
        assert {(r.lang, r.gram, r.n) for r in collocations.flows(collocations.edges(df, 5, 5, bits), 5).collect()} == want
    monkeypatch.setattr(collocations, "sieve", lambda texts, min_count, longest, bits: zlib.compress(b"\xff" * (1 << bits - 3)))
    graph = collocations.edges(df, 5, 5, 16)
    assert {(r.lang, r.gram, r.n) for r in collocations.flows(graph, 5).collect()} == want
    edges = {(r.lang, r.gram): r.n for r in graph.filter("words = 5").collect()}
    assert edges == {(lang, " ".join(p)): n for lang, c in f.items() for p, n in c.items() if len(p) == 5}


@pytest.mark.parametrize("text", ["a b. c d e f, g h " * 30, "word " * 200, "x" * 300, "x" * 90 + " y z  w\tv u " + "q" * 90 + "!", "ab " * 20 + "." + "c" * 100 + " d"])
def test_texts_in_parts_give_the_same_words(text):
    raw = text.encode()
    parts = list(collocations.parts_of(raw, 5, 64))
    assert b"".join(p[:own] for p, own in parts) == raw
    grams = lambda parts: Counter(w for p in parts for w in spans(collocations.Words([p], ["en"])))

    def spans(words):
        for i in range(len(words.starts)):
            if words.owned[i]:
                k = 1
                while k < 5 and words.together[i + k - 1]:
                    k += 1
                yield words.bytes[words.starts[i] : words.ends[i + k - 1]]

    assert grams(parts) == grams([(raw, len(raw))])


def test_passages_are_whole_unary_paths(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(f"{passage}. a b c d e", "en")] * 7 + [(f"start here {passage}", "en"), ("w3 w4 w5 w6 w7 w8", "en")]
    flow = collocations.flows(collocations.edges(spark.createDataFrame(docs, "text string, lang string"), 5), 5)
    words = passage.split()
    want = {(" ".join(words[:7]), 3, 8), (" ".join(words[3:9]), 2, 9), (" ".join(words[5:]), 31, 8), ("a b c d e", 1, 7)}
    assert {(r.passage, r.edges, r.n) for r in collocations.unary_paths(flow).collect()} == want


def test_scores_past_64_bits_are_exact(spark):
    big = [3_000_000_000_017, 2_999_999_999_999, 91_000_000_000_003]
    flow = written(spark.createDataFrame([("en", 2, "a b", 1_999_999_999_993), ("en", 1, "a", big[0]), ("en", 1, "b", big[1])], "lang string, words int, gram string, n bigint"))
    row = collocations.scored(flow, spark.createDataFrame([("en", big[2])], "lang string, total bigint")).first()
    assert row.score == 1000 * 1_999_999_999_993 * big[2] // (big[0] * big[1])


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.edges(spark.createDataFrame([], "text string, lang string"), longest=1)


# chats

ODD_TEXTS = [None, "", "plain", "### user: hi</turn>\n", "\\", "\\\\### </turn>", "####", "</turn", "</turn></turn>\n### assistant: x", "a: b ~1 ~0", "naïve ☃\n\n", "<" * 50, "\\</turn>\\", "x" * 20_000]


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "", None, "a: b", "~", "### x", "</turn>", "\\"]
    rows = [(c, t, rng.choice(roles[:2] * 3 + roles), rng.choice(ODD_TEXTS)) for c in [1, 2, 3, None, -7] for t in range(12)]
    rows += [(4, 0, "user", "no reply"), (5, None, "user", "first"), (5, 0, "assistant", "last"), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (6, 1, "assistant", "a")]
    rows += [(8, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]
    rng.shuffle(rows)
    return rows


def told(rows):
    """{conv_id: [(role, text)]} in order."""
    out = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def test_chats(spark, chats):
    df = spark.createDataFrame(chats, CHATS).withColumns({c: F.lit(1) for c in ("place", "start", "formatted", "head", "body", "trains")}).repartition(3)
    turns = written(chat_format.format_turns(df))
    want, text = told(chats), defaultdict(str)
    for r in turns.orderBy("place").collect():
        assert r.start == len(text[r.conv_id])
        text[r.conv_id] += r.formatted
    assert {c: chat_format.parse(t) for c, t in text.items()} == want
    examples = defaultdict(list)
    for r in chat_format.expand(turns).orderBy("place").collect():
        whole = text[r.conv_id]
        assert whole[r.context_chars :].startswith(r.target)
        examples[r.conv_id].append((chat_format.parse(whole[: r.context_chars]), chat_format.parse(r.target)[0][1]))
    assert examples == {c: e for c, t in want.items() if (e := [(t[:i], x) for i, (role, x) in enumerate(t) if role == "assistant"])}
    for r in chat_format.render(turns).collect():
        assert (r.context, r.mask_start) == (text[r.conv_id][: len(r.context)], len(r.context) + r.target.index(": ") + 2)
        assert text[r.conv_id].startswith(r.context + r.target)


def test_chats_are_read_back(spark, chats):
    want, turns = told(chats), chat_format.format_turns(spark.createDataFrame(chats, CHATS).repartition(5))
    rows = {r.conv_id: r for r in chat_format.read_back(turns).collect()}
    assert rows.keys() == want.keys()
    for c, t in want.items():
        loss = "".join(x for role, x in t if role == "assistant")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{role}\n{x}\n" for role, x in t), loss)]
        assert [rows[c].n_turns, rows[c].turns_sha256, rows[c].loss_chars, rows[c].loss_sha256] == [len(t), digests[0], len(loss), digests[1]]
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], CHATS))).count() == 0


def test_losses_are_those_of_the_examples(spark, chats, monkeypatch):
    """Reading back goes through the examples: without one of them its reply is missing, and a wrong context is an error."""
    turns, expand = written(chat_format.format_turns(spark.createDataFrame(chats, CHATS))), chat_format.expand
    count = lambda: {r.conv_id: r.n_examples for r in chat_format.read_back(turns).collect()}[8]
    assert count() == 150 and turns.count() == expand(turns, whole=True).count()
    monkeypatch.setattr(chat_format, "expand", lambda t, whole=False: expand(t, whole).withColumns({c: F.when(F.col("place") > 2, F.col(c)) for c in ("context_chars", "target", "reply_start", "reply_chars")}))
    assert count() == 149
    monkeypatch.setattr(chat_format, "expand", lambda t, whole=False: expand(t, whole).withColumn("context_chars", F.col("context_chars") + 1))
    with pytest.raises(Exception, match="came before"):
        count()


# prefix trie


def brute_trie(rows, block=100, shared=6):
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        whole[c] = tuple(own.get(c - c % block, [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()}


def random_chats(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 140), *range(250, 270), 300, -7, -100, -130]:
        start = rng.choice([0, 0, 3, 30])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > start else "user", rng.choice(["a", "bb", "", None]) if t > start else f"same {t}") for t in range(rng.choice([1, 2, 5, 9, 33]))]
    rows += [(c, None, None, "first") for c in (3, 100)] + [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(900 + i, t, "user", f"copy {t}") for i in range(30) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [1, 20, 4096])
def test_trie(spark, local):
    rows = random_chats(local)
    df = spark.createDataFrame(rows, CHATS).withColumns({c: F.lit(1) for c in ("pos", "key", "depth", "points", "one", "base", "p1")}).repartition(3)
    found = [tuple(r) for r in prefix_trie.prefix_trie(df, local=local).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_of_one_long_conversation(spark):
    """A path of 1,200 nodes is halved again and again."""
    rows = [(50, t, "user", f"t{t}") for t in range(1200)] + [(51, t, "user", f"t{t}") for t in range(600)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, CHATS), local=300).collect()} == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CHATS)).count() == 0
