"""The prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Conversations are first rebuilt: conversation c begins with the first h turns of conversation ``c - c % 100`` (h = crc32 of
c in decimals, modulo 6), then come its own turns after its first h. A node is a sequence of turns that rebuilt conversations
begin with. Its name is (conv_id, depth), conv_id being the smallest of its members, so the path from a node up to the root
is the path of that conversation, and can be looked up by (conv_id, depth) without following parents.

Sums over subtrees (``subtree_sums``): a part of the forest is split at its centroid, the deepest node that has half of the
part's weight below it. What hangs below each of the centroid's children is a part of its own, what is left above it another, and
each has at most half the weight. The total of the centroid's subtree is added to it and to the nodes on the path from it to the
part's top. After the logarithm of the weight in rounds all parts are at most ``LOCAL`` heavy; these are bounded, and are
summed side by side in tasks. A node weighs as many conversations as pass through it: what a subtree weighs is then the
number of turns its members have from there on, which is known before anything is rolled up.

Turns are dealt out by ranges of their order and counted by ``boxlake.operators.ordered``, so a conversation that holds much of
the table is no one's. Texts are read once and travel as hashes of 128 bits; a hot key is only counted, or joined between
written tables that adaptive execution can split. A node's member ids are hashed as a sorted stream.

Defined results: null roles and texts are empty; a null turn comes first, equal turns go by role, then by the text's MD5; repeated
rows are turns of their own; rows without conv_id belong to no conversation; very long texts count whole; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import drop_written, read_table, written
from boxlake.operators.ordered import in_ranges, running

BLOCK, SHARED = 100, 6
#: Weight, and so nodes, of parts that are summed in one task.
LOCAL = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _marks(depth, key) -> list:
    """Two 64-bit hashes of a turn at its depth; xor of those of all turns names the sequence."""
    return [F.xxhash64(F.lit(i), depth.cast("long"), key) for i in (1, 2)]


def rebuilt(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """conv_id, depth, p1, p2, points, turns: a row for every depth (0 included) of each rebuilt conversation. p1 and p2 name
    the sequence up to there, points is the length of its last text, turns the conversation's number of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("text_key"), F.length(text).cast("long").alias("points"))
    placed = in_ranges(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "text_key").withColumn("one", F.lit(1).cast("long"))
    key = F.md5(F.concat_ws(":", F.length("role"), "role", "text_key"))
    turns = written(running(placed, ["conv_id"], {"pos": ("sum", "one")}).select("conv_id", "pos", "points", key.alias("key"), "__range", "__place"), "trie-turns")

    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("len")).select("conv_id", "len", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % shared).alias("h"))
    firsts = turns.filter((F.pmod("conv_id", F.lit(block)) == 0) & (F.col("pos") < shared)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "points"))).alias("first"))
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,key:string,points:bigint>>")), 1, F.col("h").cast("int"))
    convs = sizes.join(firsts, "base", "left").withColumn("head", head)
    m1, m2 = (F.expr(f"aggregate(head, 0L, (s, x) -> s ^ xxhash64({i}, x.pos, x.key))") for i in (1, 2))
    convs = written(convs.select("conv_id", "h", "head", m1.alias("m1"), m2.alias("m2"), (F.size("head") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).cast("long").alias("turns")), "trie-conversations")

    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("shared"), "m1", "m2", "turns"), "conv_id").filter("pos > h").withColumn("depth", F.col("shared") + F.col("pos") - F.col("h"))
    x1, x2 = _marks(F.col("depth"), F.col("key"))
    own = written(own.select("conv_id", "depth", "points", "turns", "m1", "m2", x1.alias("x1"), x2.alias("x2"), "__range", "__place"), "trie-own")
    own = running(own, ["conv_id"], {"o1": ("xor", "x1"), "o2": ("xor", "x2")})
    own = own.select("conv_id", "depth", F.col("o1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("o2").bitwiseXOR(F.col("m2")).alias("p2"), "points", "turns")
    begun = convs.select("conv_id", "turns", "head", F.explode(F.sequence(F.lit(0), F.size("head"))).alias("depth"))
    p1, p2 = (F.expr(f"aggregate(slice(head, 1, depth), 0L, (s, x) -> s ^ xxhash64({i}, x.pos, x.key))") for i in (1, 2))
    points = F.coalesce(F.try_element_at("head", F.when(F.col("depth") > 0, F.col("depth")))["points"], F.lit(0))
    begun = begun.select("conv_id", F.col("depth").cast("long").alias("depth"), p1.alias("p1"), p2.alias("p2"), points.alias("points"), "turns")
    out = written(begun.unionByName(own), "trie-members")
    drop_written(turns, convs)
    return out


def _summed(sums: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows conv_id, depth, parent_conv, top_conv, top_depth, sums, added sums, ordered by top: to conv_id, depth, sums over subtrees.
    A task holds a batch and one unfinished part, which LOCAL bounds."""

    def rolled(rows: np.ndarray) -> pa.RecordBatch:
        conv, depth, parent, top_conv, top_depth = rows[:5]
        values, level = rows[5 : 5 + sums].copy(), depth - top_depth
        part = np.cumsum(np.concatenate([[0], (top_conv[1:] != top_conv[:-1]) | (top_depth[1:] != top_depth[:-1])]))
        ids, place = np.unique(np.concatenate([conv, parent]), return_inverse=True)
        deep = int(level.max(initial=0)) + 1
        name = lambda of, at: (part * deep + at) * len(ids) + of
        mine, above = name(place[: len(conv)], level), name(place[len(conv) :], level - 1)
        order = np.argsort(mine)
        under = order[np.minimum(np.searchsorted(mine, above, sorter=order), len(order) - 1)]
        by_level = np.argsort(-level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[by_level])) + 1
        for group in np.split(by_level, cuts):
            if level[group[0]] > 0:
                for v in values:
                    np.add.at(v, under[group], v[group])
        out = values + rows[5 + sums :]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, depth, *out)], names=["conv_id", "depth", *(f"s{i}" for i in range(sums))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5 + 2 * sums, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not held.shape[1]:
                continue
            whole = int(np.argmax((held[3] == held[3, -1]) & (held[4] == held[4, -1])))  # where the last part begins
            if whole:
                yield rolled(held[:, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield rolled(held)

    return run


def subtree_sums(nodes: DataFrame, paths: DataFrame, names: list[str], local: int = LOCAL) -> DataFrame:
    """conv_id, depth and, for each name, the sum of that column over the node's subtree.

    nodes: conv_id, depth, parent_conv (null: no parent), weight and the columns; weight is positive and summed over the subtree. paths:
    conv_id, depth, node_conv, parent_conv, the nodes on the way to every node under its conv_id."""
    top, place = ["top_conv", "top_depth"], ["conv_id", "depth"]
    added = [f"added_{n}" for n in names]
    zero = F.lit(0).cast("long")
    active = nodes.select(*place, F.coalesce("parent_conv", F.lit(-1)).cast("long").alias("parent_conv"), zero.alias("top_conv"), zero.alias("top_depth"), "weight", *(F.col(n).cast("long").alias(n) for n in names), *(zero.alias(a) for a in added))
    active = written(active, "trie-parts")
    light, done = [], []
    while True:
        large = written(active.groupBy(*top).agg(F.max("weight").alias("whole")).filter(F.col("whole") > local), "trie-large")
        light.append(active.join(large, top, "left_anti"))
        if large.isEmpty():
            break
        half = active.join(large, top).filter(2 * F.col("weight") >= F.col("whole"))
        centroids = half.groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c")).select(*top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
        centroids = written(centroids, "trie-centroids")
        # below the centroid is what has one of its children on its path
        child = paths.select("conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("node_conv").alias("child"), F.col("parent_conv").alias("child_of"))
        side = F.when((F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv")), F.lit(0)).when((F.col("depth") > F.col("c_depth")) & (F.col("child_of") == F.col("c_conv")), F.lit(1)).otherwise(F.lit(-1))
        sided = written(active.join(centroids, top).join(child, ["conv_id", "c_depth"], "left").withColumn("side", side), "trie-sides")
        totals = written(sided.filter("side >= 0").groupBy(*top, "c_conv", "c_depth", "c_weight").agg(*(F.sum(n).alias(f"total_{n}") for n in names)), "trie-totals")
        done.append(sided.filter("side = 0").join(totals.drop("c_conv", "c_depth", "c_weight"), top).select(*place, *((F.col(f"total_{n}") + F.col(a)).alias(n) for n, a in zip(names, added, strict=True))))
        way = totals.drop("top_conv").join(paths.select(F.col("conv_id").alias("c_conv"), "depth", F.col("node_conv").alias("conv_id")), "c_conv").filter((F.col("depth") < F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
        way = way.select(*place, F.col("c_weight").alias("less"), *(f"total_{n}" for n in names))
        keep = [*place, "parent_conv", *top, "weight", *names, *added]
        above = sided.filter("side < 0").select(*keep).join(way, place, "left").withColumns({"weight": F.col("weight") - F.coalesce("less", zero)} | {a: F.col(a) + F.coalesce(f"total_{n}", zero) for n, a in zip(names, added, strict=True)})
        below = sided.filter("side > 0").withColumns({"top_conv": F.col("child"), "top_depth": F.col("c_depth") + 1})
        active = written(above.select(*keep).unionByName(below.select(*keep)), "trie-parts")
    parts = reduce(DataFrame.unionByName, light).select(*place, "parent_conv", *top, *names, *added)
    ordered = parts.repartition(*top).sortWithinPartitions(*top)
    small = ordered.mapInArrow(_summed(len(names)), "conv_id bigint, depth bigint, " + ", ".join(f"s{i} bigint" for i in range(len(names))))
    return reduce(DataFrame.unionByName, done, small.select(*place, *(F.col(f"s{i}").alias(n) for i, n in enumerate(names))))


def _ids_digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows p1, p2, depth, conv_id in order: to a row for each sequence with the hash of its ids, joined by commas."""
    key, state, done = None, None, []
    for batch in batches:
        for p1, p2, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (p1, p2, depth):
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (p1, p2, depth), hashlib.sha256(b"%d" % conv)
            else:
                state.update(b",%d" % conv)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "depth", "ends"), x, strict=True)) for x in done])
            done = []
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "depth", "ends"), (*key, state.hexdigest()), strict=True))])


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    members = rebuilt(conversations, block, shared)
    name = ["depth", "p1", "p2"]
    merged = members.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("points").alias("points"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"))
    merged = written(merged, "trie-merged")
    named = members.join(merged.select("conv_id").distinct(), "conv_id", "left_semi").join(merged.select(*name, F.col("conv_id").alias("node_conv")), name).select("conv_id", "depth", "node_conv")
    named = written(named, "trie-named")
    before = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv"))
    paths = written(named.join(before, ["conv_id", "depth"], "left"), "trie-paths")
    nodes = merged.join(paths.drop("node_conv"), ["conv_id", "depth"])
    children = nodes.filter("parent_conv is not null").groupBy(F.col("parent_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("points")), "trie-nodes")
    drop_written(named, merged)
    sums = subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"], local)
    last = members.filter(F.col("turns") == F.col("depth")).select("p1", "p2", "depth", "conv_id")
    ends = last.repartition("p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "conv_id").mapInArrow(_ids_digested, "p1 bigint, p2 bigint, depth bigint, ends string")
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(ends, name, "left")
    return out.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_prefix_trie": op13_prefix_trie}
ORACLE = {
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (
  SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS base, n,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
s AS (SELECT z.*, least(h, coalesce((SELECT n FROM z b WHERE b.conv_id = z.base), 0)) AS nb FROM z),
r AS (
  SELECT s.conv_id, t.i AS d, role, text FROM s JOIN t ON t.conv_id = s.base AND t.i <= s.h
  UNION ALL SELECT s.conv_id, nb + t.i - h, role, text FROM s JOIN t USING (conv_id) WHERE t.i > h),
m AS (
  SELECT conv_id, d, length(text) AS points,
    md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM s),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(points) AS points FROM m GROUP BY d, k),
p AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.d = n.d - 1 LEFT JOIN n u ON u.d = m.d AND u.k = m.k),
c AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY ALL),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN c ON c.parent = p.conv_id AND c.d = p.d),
w AS (
  SELECT m.d, m.k, count(*) FILTER (WHERE q.n_children = 0) AS n_leaves, CAST(sum((q.n_convs - 1) * q.points) AS BIGINT) AS saved_tokens
  FROM q JOIN m ON m.conv_id = q.conv_id AND m.d <= q.d GROUP BY m.d, m.k),
e AS (
  SELECT d, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS l FROM m) WHERE d = l GROUP BY d, k)
SELECT q.conv_id, q.d AS depth, q.parent AS parent_conv_id, q.n_convs, q.n_children, w.n_leaves, w.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM q JOIN w ON w.d = q.d AND w.k = q.k LEFT JOIN e ON e.d = q.d AND e.k = q.k""",
}
