"""MinHash near-dedup: universal hash minima with banding, verification on full sets, and connected
components by alternating large-star and small-star.

Documents are linked when ``100 * intersection >= 100 * threshold * union`` of their sets of word
shingles. Documents with equal sets are one class; from there on only classes are compared:

1. Band buckets propose; a bucket is never expanded into its pairs. A shingle that one candidate alone
   holds can be shared with nobody, so a class with more than 1 - threshold of such shingles drops out.
2. In each bucket every class is paired with the most central one (fewest such shingles). A pair's signatures, a bit of
   each of the 128 minima, are compared first: clear misses are rejected there, all others are tested on their full
   sets, and the links' components are found.
3. Pairs of a centre's family that lie in different components are looked for by what they must share
   outside the centre (see ``_across``), so only pairs that share rare shingles are made, verified by signature and tested.
   Links within a component change nothing: no component is missed.

With 32 bands of 4 minima a pair at the threshold 0.8 shares no bucket with probability 5e-8. Its signatures agree in 9 bits of 10 on
average; a pair is rejected where fewer agree than a true one has with a probability of ``MISSED`` at most.

Defined results: null and blank texts have an empty set and are linked with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; very long texts are shingled whole; rows that
repeat doc_id and text are one node, different texts under one doc_id are nodes of their own; a null
doc_id is linked with nothing; an empty table gives an empty table; ``drop_near_copies`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.llm.common import as_row, drop_written, read_table, row_key, written
from boxlake.llm.hashing import mix, shingle_sets, slices_of

BANDS, ROWS = 32, 4
#: Probability with which a pair at the threshold may be rejected by its signatures.
MISSED = 1e-9
SLICE_BYTES = 1 << 18
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def minima(values: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """The least of multiplier * value + addend modulo 2**64 over the values, for each pair of them."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):  # bounded however long the text
        part = multipliers[:, None] * values[None, at : at + 2048] + addends[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> list[int]:
    """A bit of each minimum, 64 to a number; where two sets have the same minimum their bits agree, else in half of all cases."""
    bits = np.packbits((mix(least) & np.uint64(1)).astype(np.uint8))
    return np.frombuffer(np.pad(bits, (0, -len(bits) % 8)).tobytes(), np.int64).tolist()


def least_agreement(threshold: float, minima: int, missed: float = MISSED) -> int:
    """The most bits such that a pair of this similarity agrees in fewer with a probability of missed at most (a binomial sum)."""
    p, total = (1 + threshold) / 2, 0.0
    for k in range(minima + 1):
        total += math.comb(minima, k) * p**k * (1 - p) ** (minima - k)
        if total > missed:
            return k
    return minima


def _set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _signatures(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _SEEDS if 2 * bands * rows <= len(_SEEDS) else mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
        mul, add = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows : 2 * bands * rows]
        weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        which = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices_of(batch, 1, SLICE_BYTES):
                sets = shingle_sets([(x or "").encode() for x in part.column(1).to_pylist()], words)
                keys = [_set_key(s) for s in sets]
                least = [minima(s, mul, add) if len(s) else None for s in sets]
                values = [None if m is None else mix((m.reshape(bands, rows) * weights).sum(axis=1) + which).view(np.int64) for m in least]
                signs = [None if m is None else signature(m) for m in least]
                arrays = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "sign"])

    return run


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, 1, SLICE_BYTES):
                sets = shingle_sets([(x or "").encode() for x in part.column(1).to_pylist()], words)
                same = [_set_key(s) == k for s, k in zip(sets, part.column(2).to_pylist(), strict=True)]  # not so where rows share an id
                ids = part.column(0).filter(pa.array(same, pa.bool_()))
                held = [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.list_(pa.int64()))], names=["doc", "shingles"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the full sets sa and sb."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    return left.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")


def _verified(pairs: DataFrame, signs: DataFrame, least: int, minima: int) -> DataFrame:
    """a, b, an, bn, close of pairs: their sizes, and whether their signatures (doc, n, sign) agree in so many bits."""
    end = lambda x: signs.select(F.col("doc").alias(x), F.col("n").alias(f"{x}n"), F.col("sign").alias(f"{x}_sign"))
    differ = F.aggregate(F.zip_with("a_sign", "b_sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "an", "bn", (F.lit(minima) - differ >= least).alias("close"))


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, shared, an, bn, linked: pairs counted on their full sets."""
    counted = _with_sets(pairs, sets).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), F.size("sa").cast("long").alias("an"), F.size("sb").cast("long").alias("bn"))
    return written(counted.withColumn("linked", 100 * F.col("shared") >= percent * (F.col("an") + F.col("bn") - F.col("shared"))), "near-tested")


def _across(star: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of different components, members of one centre's family, that may still be linked.

    A pair must share percent / (100 + percent) of both sizes together. What it shares inside the centre is
    at most the less of what each has of it; the rest has to come from shingles outside. Of those, taken
    from the rarest in the family, each side's first (count - needed + 1) must have one in common, so only
    pairs that meet there are made; unique shingles, which come first, meet nobody. Pairs that need nothing
    from outside differ in size and are found by classes of size. used gets the tables that the result reads.
    """
    family = star.select(F.col("a").alias("c"), F.col("b").alias("doc"), F.col("bn").alias("n"))
    family = family.unionByName(star.select(F.col("a").alias("c"), F.col("a").alias("doc"), F.col("an").alias("n")).distinct())
    root_of = lambda df, column, name: df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))
    rooted = root_of(root_of(family, "doc", "root"), "c", "main")
    rooted = written(rooted, "near-family")
    used.append(rooted)
    split = rooted.filter("root <> main").select("c").distinct()
    open_rows = written(rooted.join(split, "c"), "near-open")
    used.append(open_rows)

    outside = _with_sets(open_rows.filter("doc <> c").select(F.col("c").alias("a"), F.col("doc").alias("b")), sets)
    tokens = written(outside.select(F.col("a").alias("c"), F.col("b").alias("doc"), F.explode(F.array_except("sb", "sa")).alias("token")), "near-outside")
    used.append(tokens)
    n_outside = tokens.groupBy("c", "doc").agg(F.count(F.lit(1)).alias("n_outside"))
    open_rows = written(open_rows.join(n_outside, ["c", "doc"], "left").withColumn("inside", F.col("n") - F.coalesce("n_outside", F.lit(0))).drop("n_outside"), "near-inside")
    used.append(open_rows)
    common = tokens.groupBy("c", "token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = Window.partitionBy("c", "doc")  # a document's shingles
    shared = tokens.join(common, ["c", "token"]).withColumn("later", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(mine.orderBy("df", "token")))
    placed = shared.join(open_rows, ["c", "doc"]).select("c", "token", "doc", "n", "inside", "root", "main", (F.col("later") - F.col("place") + 1).alias("left"))
    # a partner has percent / 100 of n at least, and shares no more inside the centre than this side has of it
    placed = placed.filter(100 * (F.col("left") + F.col("inside")) >= percent * F.col("n"))
    placed = written(placed, "near-placed")
    used.append(placed)
    roots_of = placed.groupBy("c", "token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("c", "token")
    used.append(roots_of := written(roots_of, "near-tokens"))
    placed = placed.join(roots_of, ["c", "token"], "left_semi")  # other tokens link nothing that is apart
    side = lambda df, s: df.select("c", *(x for x in ("token", "size_class") if x in df.columns), *(F.col(x).alias(f"{s}_{x}") for x in ("doc", "n", "inside", "root", "left") if x in df.columns))
    need = F.col("y_n") + F.col("x_n")
    within = F.least("y_inside", "x_inside")
    apart = F.col("y_root") != F.col("x_root")
    # left counts a side's shingles from this one on: enough must remain on both
    lacking = percent * need - (100 + percent) * within
    meets = apart & (lacking > 0) & ((100 + percent) * F.least("y_left", "x_left") >= lacking)
    by_token = side(placed.filter("root <> main"), "y").join(side(placed, "x"), ["c", "token"]).filter(meets)
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(1.03))).cast("int")
    low, high = F.col("n") * percent / 100, F.col("inside") * (100 + percent) / percent - F.col("n")
    minor = open_rows.filter("root <> main").filter(high >= low).withColumn("size_class", F.explode(F.sequence(size_class(low), size_class(high))))
    by_size = side(minor, "y").join(side(open_rows.withColumn("size_class", size_class(F.col("n").cast("double"))), "x"), ["c", "size_class"]).filter(apart & (lacking <= 0))
    return by_token.select("y_doc", "x_doc").union(by_size.select("y_doc", "x_doc")).select(F.least("y_doc", "x_doc").alias("a"), F.greatest("y_doc", "x_doc").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component; links are (a, b).

    Large-star hangs a node's larger neighbours under its smallest; small-star does so with the smaller
    ones; both are a minimum by node joined back, repeated until all components are stars: no node hangs
    under two others, or under one while others hang under it.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        open_nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0")
        if open_nodes.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "star-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(hung.filter("u <> v").distinct(), "star-edges")
        drop_written(before, large)


def _nodes(docs: DataFrame) -> tuple[Column, bool]:
    """What tells nodes apart: doc_id, and the text as well (true) where a doc_id has several texts."""
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row_key("text")).alias("low"), F.max(row_key("text")).alias("high"))
    if texts.filter("low <> high").isEmpty():
        return F.col("doc_id"), False
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", row_key("text").alias("text"))), True


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    key, several = _nodes(docs)
    out = _near(docs.select(key.alias("doc_id"), "text"), words, threshold, bands, rows)
    return out.select("doc_id.doc_id", "n_shingles", F.col("component_id.doc_id").alias("component_id"), "kept") if several else out


def _near(docs: DataFrame, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """near_duplicates where a doc_id has one text; it may be of any type that can be ordered."""
    percent = round(100 * threshold)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sig = written(docs.select("doc_id", "text").mapInArrow(_signatures(words, bands, rows), f"doc_id {id_type}, n_shingles bigint, set_key binary, bands array<bigint>, sign array<bigint>"), "near-signatures")
    classes = written(sig.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc")), "near-classes")
    reps = sig.withColumnRenamed("doc_id", "doc").join(classes, ["set_key", "doc"], "left_semi")
    banded = reps.select("doc", "n_shingles", "set_key", F.explode("bands").alias("bucket"))
    buckets = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("n > 1"), "near-buckets")
    twos = buckets.filter("n = 2").select("bucket", F.explode(F.array("low", "high")).alias("doc"))
    more = banded.select("bucket", "doc").join(buckets.filter("n > 2").select("bucket"), "bucket")
    members = written(twos.union(more), "near-members")

    wanted = written(members.select("doc").distinct(), "near-candidates")
    keyed = written(classes.join(wanted, "doc", "left_semi").select("doc", F.col("set_key").alias("wanted_key")), "near-wanted")
    texts = docs.select("doc_id", "text").join(keyed.hint("merge"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted_key")
    sets = written(texts.mapInArrow(_sets(words), f"doc {id_type}, shingles array<bigint>"), "near-sets")
    held = sets.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    alone = held.filter("doc = last").groupBy("doc").agg(F.count(F.lit(1)).alias("unique"))
    size = F.size("shingles").cast("long")
    shared = sets.select("doc", size.alias("n")).distinct().join(alone, "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("unique", F.lit(0))).alias("g"))
    shared = written(shared.filter(100 * F.col("g") >= percent * F.col("n")), "near-shared")

    live = written(members.join(shared, "doc"), "near-live")
    centres = live.groupBy("bucket").agg(F.min(F.struct(((F.col("n") - F.col("g")) / F.col("n")).alias("alone"), "doc")).alias("centre"))
    star = live.join(centres.select("bucket", F.col("centre.doc").alias("a")), "bucket").filter("doc <> a")
    signs = written(reps.select("doc", F.col("n_shingles").alias("n"), "sign").join(wanted, "doc", "left_semi"), "near-signs")
    verify = lambda pairs: written(_verified(pairs, signs, least_agreement(threshold, bands * rows), bands * rows), "near-verified")
    star = verify(star.select("a", F.col("doc").alias("b")).distinct())
    used = [buckets, members, wanted, keyed, sets, shared, live, signs, star]
    used.append(tested := _tested(star.filter("close"), sets, percent))
    links = tested.filter("linked").select("a", "b")
    roots = connected_components(links)
    used.append(rest := verify(_across(star, roots, sets, percent, used)))
    if not (rest := rest.filter("close")).isEmpty():
        used.append(tested := _tested(rest, sets, percent))
        roots = connected_components(links.union(tested.filter("linked").select("a", "b")))
    drop_written(*used)  # the result reads signatures, classes and roots

    of_class = classes.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("root", "doc").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each component, with all columns. Where a doc_id has several texts, each is a node."""
    key, _ = _nodes(docs)
    gone = _near(docs.select(key.alias("doc_id"), "text"), words, threshold, BANDS, ROWS).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = written(gone, "near-gone")
    packed = docs.select(as_row(docs).alias("row"), key.alias("key"))
    return packed.join(gone, packed["key"] == gone["gone"], "left_anti").select("row.*")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_minhash": op8_minhash}
ORACLE = {
    "op8_minhash": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
