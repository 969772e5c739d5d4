"""Phrase collocations by a weighted de Bruijn graph of words.

Nodes of the graph are runs of words, edges the longest grams (``longest`` words) that overlap in all words but one.
Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``;
all counts are per language.

1. Every place of a piece gives its longest gram: an edge, or near a piece's end a shorter one, the correction for
   what no edge leaves from. Equal ones are added up (``edges``).
2. The flow through a node, which is the count of a shorter phrase, is the weight of the edges that leave it plus its
   corrections (``flows``).
3. A node that hands all its flow to one edge, on either side, lies on a unary path and is compacted into that edge:
   the phrase is contained in a longer one as frequent (``compacted``). ``unary_paths`` joins edges of one weight whose
   shared node has no other flow into whole passages.

A phrase under ``min_count`` is no candidate, and a place goes into the graph only as far as it may begin one. A sieve
decides that: words, pairs and triples are counted by hash buckets, and pieces are cut where a bucket stays below
``min_count``. Cuts act like piece ends. A bucket can only be fuller than what is counted in it, so every flow of
min_count and more is exact, whatever the sieve lets through. Its size is fixed (2 ** ``sieve_bits`` bits, 8 MB at 26),
so it may be sent to all executors at every size of corpus; once far more than min_count * 2 ** sieve_bits words are
counted it lets most through and saves little: raise either with the corpus.

Defined results: null and empty texts have no words; a null language is ``und``; texts over ``SLICE_BYTES`` are cut at piece
ends, or within a longer piece between words, with the words that follow in sight, so memory is bounded but for a single
word that is longer; repeated rows count each; ties in score go by count, then by the phrase's bytes; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.llm.common import drop_written, read_table, written
from boxlake.llm.hashing import LOWERED, mix, prefix_hashes, slices_of, span_hashes

MIN_COUNT, LONGEST, TOP, UNKNOWN = 100, 5, 2000, "und"
SLICE_BYTES = 1 << 20
#: Words, pairs and triples that a task gathers before it counts their buckets.
GATHERED = 2 << 20
#: Buckets of the sieve, and how many of them are counted together.
SIEVE_BITS, SHARD_BITS = 26, 16
#: 0: of a word; 1: between words; 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_BESIDE = mix(np.arange(257, 513, dtype=np.uint64))
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def parts_of(text: bytes, longest: int, most: int = SLICE_BYTES) -> Iterator[tuple[bytes, int]]:
    """The text in parts of about ``most`` bytes, with the bytes of each that are its own: words that begin later are only
    there to be seen from its last words."""
    ahead = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (longest - 1))
    at = 0
    while len(text) - at > most:
        kind = _KIND[np.frombuffer(text, np.uint8, most, at)]
        if len(ends := np.flatnonzero(kind == 2)):
            cut = seen = at + int(ends[-1]) + 1
        else:
            if len(ends := np.flatnonzero(kind[1:] == 1)):
                cut = at + int(ends[-1]) + 1
            else:
                found = _EDGE.search(text, at + most)
                cut = found.start() if found else len(text)
            seen = ahead.match(text, cut).end()
        yield text[at:seen], cut - at
        at = cut
    yield text[at:], len(text) - at


class Words:
    """The words of many texts as places in one buffer, lower-cased, with one space between words of a piece."""

    def __init__(self, parts: list[tuple[bytes, int]], langs: list[str]):
        raw = np.frombuffer(b"\n".join(p for p, _ in parts) + b"\n", np.uint8)
        kind = _KIND[raw]
        word = np.concatenate([[False], kind == 0])
        begins = np.flatnonzero(word[1:] & ~word[:-1])
        first = np.cumsum([0, *(len(p) + 1 for p, _ in parts)])
        self.text = np.searchsorted(first, begins, "right") - 1
        self.owned = begins < (first[:-1] + np.array([own for _, own in parts], np.int64))[self.text]
        piece = np.cumsum(kind == 2)[begins]
        kept = (kind != 1) | word[:-1]  # of a run of spaces the first, if a word goes before
        buf = LOWERED[raw[kept]]
        kind = kind[kept]
        buf[kind == 1] = 32
        place = np.cumsum(kept) - 1
        word = np.concatenate([[False], kind == 0, [False]])
        self.starts, self.ends = place[begins], np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        self.bytes, self.hashes = buf.tobytes(), prefix_hashes(buf)
        self.other = np.concatenate([[np.uint64(0)], np.cumsum(_BESIDE[buf])])  # a second hash of a span, by its bytes alone
        self.together = np.concatenate([piece[1:] == piece[:-1], [False]])[: len(piece)]  # this word and the next
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.names = list(names)
        self.lang = np.array([names[x] for x in langs], np.int64)[self.text]
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in names], np.uint64)
        self.salt = salts[self.lang] if len(salts) else np.zeros(0, np.uint64)

    def keys(self, at: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """Hashes of the grams of so many words that begin at these words, by language."""
        return mix(span_hashes(self.hashes, self.starts[at], self.ends[at + words - 1]) ^ self.salt[at])

    def runs(self) -> Iterator[np.ndarray]:
        """For one, two and three words: where so many of one piece begin."""
        yield np.arange(len(self.starts))
        yield np.flatnonzero(self.together)
        yield np.flatnonzero(self.together[:-1] & self.together[1:])


def _slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Words]:
    """Words of about SLICE_BYTES of text at a time; columns are text as bytes, lang."""
    for batch in batches:
        for rows in slices_of(batch, 0, SLICE_BYTES):
            texts, langs = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            if len(texts) > 1 or len(texts[0] or b"") <= SLICE_BYTES:
                yield Words([(t or b"", len(t or b"")) for t in texts], langs)
            else:
                for part in parts_of(texts[0], longest):
                    yield Words([part], langs)


def _bucketed(longest: int, min_count: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to a row for each shard of the sieve's buckets: which are met, and how often (min_count is enough)."""

    def counted(ids: np.ndarray) -> pa.RecordBatch:
        ids, n = np.unique(ids, return_counts=True)
        n = np.minimum(n, min(min_count, 65535)).astype(np.uint16)
        shard, first = np.unique(ids >> SHARD_BITS, return_index=True)
        low = (ids & np.uint32((1 << SHARD_BITS) - 1)).astype(np.uint16)
        cuts = [*first.tolist(), len(ids)]
        # bytes in planes: steps between buckets are mostly under 256 and counts under 2, so a plane of zeros packs well
        packed = [b"".join(np.ascontiguousarray(x.view(np.uint8)[k::2]).tobytes() for x in (np.diff(low[a:b], prepend=np.uint16(0)), n[a:b]) for k in (0, 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for words in _slices(batches, longest):
            held += [(words.keys(at[words.owned[at]], k) >> np.uint64(64 - bits)).astype(np.uint32) for k, at in zip(range(1, min(longest, 3) + 1), words.runs())]
            if sum(map(len, held)) >= GATHERED:
                yield counted(np.concatenate(held))
                held = []
        if held:
            yield counted(np.concatenate(held))

    return run


def _summed(min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Those rows to one row a shard: its buckets of min_count and more as bits. A task holds 256 KB for each of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, met in zip(*batch.to_pydict().values(), strict=True):
                planes = np.frombuffer(met, np.uint8).reshape(4, -1).astype(np.uint32)
                counts = held.setdefault(shard, np.zeros(1 << SHARD_BITS, np.uint32))
                at = np.cumsum(planes[0] + (planes[1] << np.uint32(8)))
                counts[at] = np.minimum(counts[at] + planes[2] + (planes[3] << np.uint32(8)), min_count)
        full = {k: zlib.compress(np.packbits(v >= min(min_count, 65535)).tobytes(), 1) for k, v in held.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int32()), pa.array(list(full.values()), pa.binary())], names=["shard", "bits"])

    return run


def sieve(texts: DataFrame, min_count: int, longest: int, bits: int = SIEVE_BITS) -> bytes:
    """2 ** bits bits: buckets whose words, pairs and triples are counted min_count times or more together."""
    if not SHARD_BITS <= bits <= 32:
        raise ValueError(f"sieve_bits must be from {SHARD_BITS} to 32")
    met = texts.mapInArrow(_bucketed(longest, min_count, bits), "shard int, met binary")
    shards = met.repartition(min(64, 1 << (bits - SHARD_BITS)), "shard").mapInArrow(_summed(min_count), "shard int, bits binary")
    out = bytearray(1 << (bits - 3))
    for shard, packed in shards.collect():  # as many bits as the sieve has, whatever the corpus
        out[shard << (SHARD_BITS - 3) : (shard + 1) << (SHARD_BITS - 3)] = zlib.decompress(packed)
    return zlib.compress(bytes(out), 1)


def _gathered(longest: int, bits: int, held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to lang, words, gram, n: each place's longest gram that the sieve lets through, added up by slice; words = 0: all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(held.value), np.uint8)

        def let_through(keys: np.ndarray) -> np.ndarray:
            at = keys >> np.uint64(64 - bits)
            return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

        for words in _slices(batches, longest):
            n = len(words.starts)
            totals = np.bincount(words.lang[words.owned], minlength=len(words.names))
            through = []
            for k, at in zip(range(1, min(longest, 3) + 1), words.runs()):
                if k > 1:  # only if all of its words and pairs are
                    at = at[through[k - 2][at] & through[k - 2][at + 1]]
                ok = np.zeros(n + 1, bool)
                ok[at[let_through(words.keys(at, k))]] = True
                through.append(ok)
            size = through[0][:n].astype(np.int64)
            if longest > 1:
                size[through[1][:n]] = 2
            if longest > 2:
                # from here on so many places in a row begin a triple that is let through
                stops = np.flatnonzero(~through[2])
                row = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
                size = np.where(row > 0, np.minimum(row + 2, longest), size)
            at = np.flatnonzero((size > 0) & words.owned)
            begin, end = words.starts[at], words.ends[at + size[at] - 1]
            keys, other = words.keys(at, size[at]), words.other[end] - words.other[begin]
            order = np.argsort(keys)
            keys, other = keys[order], other[order]
            fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])])[: len(keys)])
            one = order[fresh]  # a place of each gram; a gram may come in several rows, two grams in none
            grams = [words.bytes[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
            names = pa.array(words.names, pa.string())
            rows = pa.concat_arrays([names.take(pa.array(words.lang[at[one]])), names]), np.concatenate([size[at[one]], np.zeros(len(totals), np.int64)]), [*grams, *([b""] * len(totals))], np.concatenate([np.diff(fresh, append=len(keys)), totals])
            yield pa.RecordBatch.from_arrays([rows[0], pa.array(rows[1].astype(np.int32)), pa.array(rows[2], pa.binary()), pa.array(rows[3].astype(np.int64))], names=["lang", "words", "gram", "n"])

    return run


def edges(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """lang, words, gram, n: the graph's edges (words = longest) and corrections (fewer words) with their weights; the row
    with words = 0 of each language has the number of all its words. Exact for all grams of min_count and more."""
    if longest < 2 or min_count < 1:
        raise ValueError("longest must be 2 or more, min_count 1 or more")
    texts = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(sieve(texts, min_count, longest, sieve_bits))
    found = texts.mapInArrow(_gathered(longest, sieve_bits, held), "lang string, words int, gram binary, n bigint")
    return written(found.groupBy("lang", "words", "gram").agg(F.sum("n").alias("n")).withColumn("gram", F.col("gram").cast("string")), "phrase-edges")


def _first(gram: Column, words: Column) -> Column:
    return F.call_function("substring_index", gram, F.lit(" "), words)


def flows(graph: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words, gram, n: the flow through every node and edge that has min_count of it or more."""
    nodes = graph.filter("words > 0").select("lang", "gram", "n", F.explode(F.sequence(F.lit(1), "words")).alias("words"))
    flow = nodes.groupBy("lang", "words", _first(F.col("gram"), F.col("words")).alias("gram")).agg(F.sum("n").alias("n"))
    return written(flow.filter(F.col("n") >= min_count), "phrase-flows")


def compacted(flow: DataFrame, percent: int = 100) -> DataFrame:
    """lang, gram of the phrases that hand at least so many percent of their flow on to a gram of one word more, on either
    side. Flow never grows along a gram, so a phrase inside any longer one of that flow is also inside one of one word more."""
    sides = F.array(_first(F.col("gram"), F.col("words") - 1), _first(F.col("gram"), 1 - F.col("words")))
    longer = flow.filter("words > 2").select("lang", F.explode(sides).alias("gram"), F.col("n").alias("on")).groupBy("lang", "gram").agg(F.max("on").alias("on"))
    return flow.join(longer, ["lang", "gram"]).filter(F.lit(100) * F.col("on") >= F.lit(percent) * F.col("n")).select("lang", "gram")


def unary_paths(flow: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, passage, edges, n: edges of the graph joined along nodes through which nothing else flows. An edge follows
    another if both have all the flow of the node between them; places along a path are found by doubling, in about the
    logarithm of its length. A finite piece can't go round such a path for ever, so none is closed."""
    whole = flow.filter(F.col("words") == longest).select("lang", "gram", "n", _first(F.col("gram"), F.lit(longest - 1)).alias("from"), _first(F.col("gram"), F.lit(1 - longest)).alias("to"))
    node = flow.filter(F.col("words") == longest - 1).select("lang", F.col("gram").alias("to"), "n")
    after = whole.select("lang", F.col("from").alias("to"), "n", F.col("gram").alias("next"))
    links = whole.join(node, ["lang", "to", "n"]).join(after, ["lang", "to", "n"]).select("lang", "gram", "next")
    # last: the farthest edge that is known to follow, so many steps away
    steps = written(whole.join(links, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("next", "gram").alias("last"), F.col("next").isNotNull().cast("long").alias("far")), "phrase-steps")
    while True:
        onward = steps.filter("far > 0").select("lang", F.col("gram").alias("last"), F.col("last").alias("beyond"), F.col("far").alias("more"))
        if steps.join(onward, ["lang", "last"], "left_semi").isEmpty():
            break
        further = written(steps.join(onward, ["lang", "last"], "left").select("lang", "gram", "n", F.coalesce("beyond", "last").alias("last"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "phrase-steps")
        drop_written(steps)
        steps = further
    path = steps.groupBy("lang", "last").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("edges"), F.max_by("gram", "far").alias("head"), F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("at"), _first(F.col("gram"), F.lit(-1)).alias("word")))).alias("along"))
    tail = F.transform(F.slice("along", 2, F.greatest(F.size("along") - 1, F.lit(0))), lambda x: x["word"])
    return path.select("lang", F.array_join(F.concat(F.array("head"), tail), " ").alias("passage"), "edges", "n")


def scored(flow: DataFrame, totals: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase that compaction leaves; totals has lang, total. Of all cuts in two parts
    the one of the lowest floor(1000 * a * n / (l * r)) counts, the first of equal ones. Decimals of 38 digits keep it exact."""
    phrases = flow.filter("words > 1").join(compacted(flow, percent), ["lang", "gram"], "left_anti")
    cuts = phrases.select("lang", "gram", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "gram", "a", "k", _first(F.col("gram"), F.col("k")).alias("head"), _first(F.col("gram"), F.col("k") - F.col("words")).alias("rest")), "phrase-cuts")
    left = flow.select("lang", F.col("gram").alias("head"), F.col("n").alias("l"))
    right = flow.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast((1000 * cast(a as decimal(17, 0)) * cast(total as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    best = both.withColumn("score", score).groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("best"))
    return best.select("lang", F.col("gram").alias("phrase"), "best.a", "best.l", "best.r", F.col("best.total").alias("n"), "best.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, percent: int = 100, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    graph = edges(docs, min_count, longest, sieve_bits)
    totals = written(graph.filter("words = 0").select("lang", F.col("n").alias("total")), "phrase-totals")
    flow = flows(graph, min_count)
    drop_written(graph)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored(flow, totals, percent).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_collocations": op11_collocations}
ORACLE = {
    "op11_collocations": r"""
WITH p AS (
  SELECT lang, w, count(*) AS c FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c * len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, w[i:i + k - 1] AS g, CAST(sum(c) AS BIGINT) AS a FROM (
    SELECT lang, w, c, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, c, unnest([1, 2, 3, 4, 5]) AS k FROM p))
  GROUP BY ALL HAVING sum(c) >= 100),
x AS (
  SELECT lang, s AS g, max(a) AS most FROM (SELECT lang, a, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS s FROM g WHERE len(g) > 2) GROUP BY ALL),
c AS (SELECT g.lang, g.g, g.a FROM g LEFT JOIN x ON g.lang = x.lang AND g.g = x.g WHERE len(g.g) > 1 AND (most IS NULL OR 100 * most < 100 * a)),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (
  SELECT k.lang, k.g, k.a, k.k, l.a AS l, r.a AS r, n.n,
    CAST((1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN g r ON r.lang = k.lang AND r.g = k.g[k.k + 1:len(k.g)] JOIN n ON n.lang = k.lang),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000""",
}
