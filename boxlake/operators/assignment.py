"""Which detection gets which ground truth: greedy by score for crowded images, and the assignment of least distance.

The first looks pairs up in a grid as detections come; the second works on pairs that a join has found. Python sees runs of
groups in Arrow batches and holds one batch, and of one group what it needs; Spark deals the groups out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.components import components
from boxlake.sources.shared import written


def _whole_groups(keys: int, use: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function for rows ordered by their first columns (so many integers): use gets runs of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if len(held[0]):
                last = int(np.argmax(np.all([k == k[-1] for k in held[:keys]], axis=0)))
                if last:
                    yield from use([c[:last] for c in held])
                    held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield from use(held)

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any key; the end follows."""
    fresh = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return np.append(np.flatnonzero(fresh), len(fresh))


#: Candidate pairs of detections and ground truth that the matcher looks at together, the detections of a block at most, and the options
#: that are kept for a detection.
_AT_ONCE, _BLOCK, _MOST = 1 << 20, 4096, 32
#: IoU down to which options are looked for, one after another.
_LEVELS = (0.9, 0.8, 0.65)


class _Crowd:
    """The free ground truth of one image and class at one threshold, in cells of centre and size, which are as many as there are boxes.
    Detections come in their order. Nearly equal boxes are looked for first and worse ones only where these are not free, so that
    what is looked at goes with the detections, however dense the boxes lie; no pair is kept. What is taken leaves the cells when
    it is half of them."""

    def __init__(self, ids: np.ndarray, corners: np.ndarray, threshold: float):
        fine = np.isfinite(corners).all(axis=0)
        if threshold > 0:
            fine &= (corners[2] > corners[0]) & (corners[3] > corners[1])
        self.threshold, self.looked_at = threshold, 0
        self._deal(ids[fine], corners[:, fine])

    def _deal(self, ids: np.ndarray, box: np.ndarray) -> None:
        self.n = n = len(ids)
        x, y, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, np.abs(box[2] - box[0]), np.abs(box[3] - box[1])
        span = lambda v: float(np.ptp(v)) if n else 0.0
        side = [max(float(v.mean()), 1e-9) if n else 1.0 for v in (w, h)]
        sizes = [np.log(np.maximum(v, 1e-9)) for v in (w, h)]
        self.low = [float(v.min()) if n else 0.0 for v in (x, y, *sizes)]
        spans = [span(x) / side[0], span(y) / side[1], span(sizes[0]), span(sizes[1])]
        fine, used = 4.0, [v for v in spans if v > 0]  # as many cells as boxes, over the axes on which they differ
        for _ in range(4):
            if wide := [v for v in used if v > fine or fine == 4.0]:
                fine = min(max((math.prod(wide) / max(n, 1)) ** (1 / len(wide)), 0.02), 4.0)
        self.step = [max(fine * s, v * s / (1 << 12)) for v, s in zip(spans, (*side, 1.0, 1.0), strict=True)]
        self.cells = [int(v * s / z) + 1 for v, s, z in zip(spans, (*side, 1.0, 1.0), self.step, strict=True)]
        key = np.zeros(n, np.int64)
        for axis, v in ((2, sizes[0]), (3, sizes[1]), (1, y), (0, x)):
            key = key * self.cells[axis] + self._cell(v, axis)
        order = np.lexsort((ids, key))
        self.key, self.ids, self.box = key[order], ids[order], box[:, order]
        self.area = (self.box[2] - self.box[0]) * (self.box[3] - self.box[1])
        self.rows = np.ascontiguousarray(self.box.T)
        self.taken, self.free = bytearray(n), n
        self.levels = [*(v for v in _LEVELS if v > self.threshold and 1 - v >= 0.5 * fine), self.threshold] if self.threshold > 0 else [self.threshold]

    def _cell(self, at: np.ndarray, axis: int) -> np.ndarray:
        return np.clip(np.floor((at - self.low[axis]) / self.step[axis]), 0, self.cells[axis] - 1).astype(np.int64)

    def _runs(self, box: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(detection, first, n) of runs of ground truth that hold all whose IoU may reach t: the boxes' sides are at most 1/t of each
        other, and they share t of the longer one."""
        count, edges = box.shape[1], {}
        for axis in (2, 3, 1, 0):
            if t > 0:
                low, high = (axis, axis + 2) if axis < 2 else (axis - 2, axis)
                side = box[high] - box[low]
                value = (box[low] + box[high]) / 2 if axis < 2 else np.log(side)
                reach = side * (max(1 - t, (1 / t - 1) / 2) + 1e-6) + 1e-6 if axis < 2 else 1e-6 - math.log(t)
                edges[axis] = self._cell(value - reach, axis), self._cell(value + reach, axis)
            else:
                edges[axis] = np.zeros(count, np.int64), np.full(count, self.cells[axis] - 1)
        of, at = np.arange(count), np.zeros(count, np.int64)
        for axis in (2, 3, 1):
            first, last = edges[axis]
            many = (last + 1 - first)[of]
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            of, at = np.repeat(of, many), np.repeat(at, many)
            at = at * self.cells[axis] + first[of] + step
        at *= self.cells[0]
        left, right = edges[0]
        first = np.searchsorted(self.key, at + left[of])
        n = np.searchsorted(self.key, at + right[of], "right") - first
        some = n > 0
        return of[some], first[some], n[some]

    def _options(self, box: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(detection, truth) of free ground truth with an IoU of t at least, best first for each detection, _MOST of them at most."""
        of, first, n = self._runs(box, t)
        by_run, parts, a, rows = np.cumsum(n), [], 0, np.ascontiguousarray(box.T)
        free = np.frombuffer(self.taken, np.uint8) == 0
        while a < len(of):  # so many runs as have _AT_ONCE candidates, one at least
            b = max(a + 1, int(np.searchsorted(by_run, (by_run[a - 1] if a else 0) + _AT_ONCE, "right")))
            some = n[a:b]
            d = np.repeat(of[a:b], some)
            g = np.repeat(first[a:b] - np.cumsum(some) + some, some) + np.arange(len(d))
            self.looked_at += len(d)
            at = np.flatnonzero(free[g])
            d, g = d[at], g[at]
            p, q = rows[d].T, self.rows[g].T
            w, h = np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]), np.minimum(p[3], q[3]) - np.maximum(p[1], q[1])
            shared = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            union = (p[2] - p[0]) * (p[3] - p[1]) + self.area[g] - shared
            value = np.divide(shared, union, out=np.zeros_like(shared), where=union != 0)
            good = np.flatnonzero(value >= t)
            parts.append((d[good], g[good], value[good]))
            if len(parts) > 1 and sum(len(x[0]) for x in parts) > _AT_ONCE:
                parts = [self._best(parts)]
            a = b
        d, g, _ = self._best(parts) if parts else (np.zeros(0, np.int64),) * 3
        return d, g

    def _best(self, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        d, g, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((self.ids[g], -value, d))
        d, g, value = d[order], g[order], value[order]
        few = np.arange(len(d)) - np.searchsorted(d, d) < _MOST
        return d[few], g[few], value[few]

    def _lists(self, box: np.ndarray) -> list[tuple[list[int], bool]]:
        """For each detection some free ground truth, best first, and whether there is no other."""
        out: list[tuple[list[int], bool]] = [([], True)] * box.shape[1]
        left = np.arange(box.shape[1])
        for t in self.levels:
            d, g = self._options(box[:, left], t)
            ends = np.cumsum(np.bincount(d, minlength=len(left)))
            n = np.diff(ends, prepend=0)
            done = (n > 0) | (t == self.threshold)
            options = g.tolist()
            for k, a, b in zip(left[done].tolist(), (ends - n)[done].tolist(), ends[done].tolist(), strict=True):
                if b > a:
                    out[k] = (options[a:b], t == self.threshold and b - a < _MOST)
            left = left[~done]
            if not len(left):
                break
        return out

    def hits(self, box: np.ndarray) -> np.ndarray:
        """For each detection (x_min, y_min, x_max, y_max by falling score) whether it takes a truth."""
        out = np.zeros(box.shape[1], np.int32)
        use = np.flatnonzero(np.isfinite(box).all(axis=0) & ((self.threshold <= 0) | ((box[2] > box[0]) & (box[3] > box[1]))))
        box, at = box[:, use], 0
        while at < len(use) and self.free:
            block = box[:, at : at + min(max(self.n // 64, 16), _BLOCK)]
            for k, (options, whole) in enumerate(self._lists(block)):
                while options:
                    taken = self.taken
                    g = next((g for g in options if not taken[g]), None)
                    if g is not None:
                        taken[g], out[use[at + k]] = 1, 1
                        self.free -= 1
                        break
                    if whole:
                        break
                    ((options, whole),) = self._lists(block[:, k : k + 1])  # those before it in the block have taken all of these
            at += block.shape[1]
            if self.free * 2 < self.n:
                free = np.frombuffer(self.taken, np.uint8) == 0
                self._deal(self.ids[free], self.box[:, free])
        return out


def greedy_by_score(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """image_id, category_id, file_name, det_id, score, hits (one for each threshold) of every detection. By falling score (then
    det_id) each takes the free ground truth of its image and class that has the highest IoU (then smallest annotation_id) and
    reaches the threshold. Boxes are dealt out by image and class, never as pairs: a task holds the ground truth of one image's
    class in a grid and reads the detections in their order, so what is written and held goes with the boxes."""
    keys, corners = ["image_id", "category_id"], ("x_min", "y_min", "x_max", "y_max")
    box = [F.col(c).cast("double").alias(c) for c in corners]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    truth = gts.select(*keys, F.lit(0).alias("__det"), F.lit(None).cast(kind(dets, "file_name")).alias("file_name"), F.col("annotation_id").alias("__id"), F.lit(None).cast(kind(dets, "score")).alias("score"), *box)
    found = dets.select(*keys, F.lit(1).alias("__det"), "file_name", F.col("det_id").alias("__id"), "score", *box)
    dealt = truth.unionByName(found).repartition(*keys).sortWithinPartitions(*keys, "__det", F.col("score").desc(), "__id")
    schema = f"image_id {kind(dets, 'image_id')}, category_id {kind(dets, 'category_id')}, file_name {kind(dets, 'file_name')}, det_id {kind(dets, 'det_id')}, score {kind(dets, 'score')}, hits array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, crowd = None, [], None  # a crowd for each threshold
        for batch in batches:
            if not batch.num_rows:
                continue
            image, category, is_det, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "category_id", "__det", "__id"))
            sides = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in corners])
            hits = np.zeros((len(thresholds), batch.num_rows), np.int32)
            starts = _starts(image, category, is_det)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if group != (key := (image[a], category[a])):
                    group, parts, crowd = key, [], None
                if is_det[a] == 0:
                    parts.append((ids[a:b], sides[:, a:b]))
                    continue
                if crowd is None:
                    truths, at = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in parts)]), np.concatenate([np.zeros((4, 0)), *(s for _, s in parts)], axis=1)
                    crowd = [_Crowd(truths, at, t) for t in thresholds]
                    parts = []
                hits[:, a:b] = [c.hits(sides[:, a:b]) for c in crowd]
            at = np.flatnonzero(is_det)
            rows = batch.take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(thresholds), pa.int32()), pa.array(hits[:, at].T.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("image_id", "category_id", "file_name", "__id", "score")] + [lists], names=["image_id", "category_id", "file_name", "det_id", "score", "hits"])

    return dealt.mapInArrow(run, schema)


def assigned(edges: list[tuple[int, int, float]]) -> list[int]:
    """Of edges (left, right, cost >= 0) those of a largest matching of least total cost: shortest augmenting paths from all free
    left ends at once, on costs that potentials keep from being negative."""
    lefts, rights = {a: i for i, a in enumerate(dict.fromkeys(e[0] for e in edges))}, {b: i for i, b in enumerate(dict.fromkeys(e[1] for e in edges))}
    out: list[list[tuple[int, float, int]]] = [[] for _ in lefts]
    for k, (a, b, cost) in enumerate(edges):
        out[lefts[a]].append((rights[b], cost, k))
    of_left, of_right = [-1] * len(lefts), [-1] * len(rights)  # the edge that is taken
    high_left, high_right = [0.0] * len(lefts), [0.0] * len(rights)
    while True:
        near_left, near_right = {i: 0.0 for i, k in enumerate(of_left) if k < 0}, {}
        came: dict[int, int] = {}  # the edge by which a right end is reached
        queue = [(0.0, i) for i in near_left]
        while queue:
            far, i = heapq.heappop(queue)
            if far > near_left[i]:
                continue
            for j, cost, k in out[i]:
                if k != of_left[i] and (d := far + max(cost + high_left[i] - high_right[j], 0.0)) < near_right.get(j, np.inf):
                    near_right[j], came[j] = d, k
                    if of_right[j] >= 0:  # on to the left end that has it, which costs nothing
                        back = lefts[edges[of_right[j]][0]]
                        if d < near_left.get(back, np.inf):
                            near_left[back] = d
                            heapq.heappush(queue, (d, back))
        free = [j for j in near_right if of_right[j] < 0]
        if not free:
            return [k for k in of_left if k >= 0]
        j = min(free, key=lambda x: near_right[x] + high_right[x])
        most = max(*near_left.values(), *near_right.values())
        high_left = [h + near_left.get(i, most) for i, h in enumerate(high_left)]
        high_right = [h + near_right.get(i, most) for i, h in enumerate(high_right)]
        while True:
            k = came[j]
            i = lefts[edges[k][0]]
            before = of_left[i]
            of_left[i], of_right[j] = k, k
            if before < 0:
                break
            j = rights[edges[before][1]]


def least_distance(found: DataFrame) -> DataFrame:
    """The rows of found (image_id, det_id, annotation_id, value and others; value is a squared distance) of the one-to-one
    assignment with most pairs and, of those, the least sum of distances. Pairs whose both ends have no other are taken as they
    are; the others meet by connected components, which share no end, so an image's size bounds nothing."""
    ends = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    counted = written(found.withColumn("__of_det", ends("image_id", "det_id")).withColumn("__of_gt", ends("image_id", "annotation_id")), together=True)
    alone = (F.col("__of_det") == 1) & (F.col("__of_gt") == 1)
    shared = counted.filter(~alone).select("image_id", "det_id", "annotation_id", "value")
    node = lambda side, c: F.struct("image_id", F.lit(side).alias("side"), F.col(c).cast("long").alias("id"))
    links = shared.select(node(0, "det_id").alias("a"), node(1, "annotation_id").alias("b"))
    roots = components(links).filter("node.side = 0").select("node.image_id", F.col("node.id").alias("det_id"), F.col("root.id").alias("root"))
    labelled = shared.join(roots, ["image_id", "det_id"], "left").select("image_id", F.coalesce("root", "det_id").alias("root"), "det_id", "annotation_id", "value")

    def take(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        image, root, det, truth, value = rows
        starts, cost, kept = _starts(image, root), np.sqrt(value).tolist(), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kept += [a + k for k in assigned(list(zip(det[a:b].tolist(), truth[a:b].tolist(), cost[a:b], strict=True)))]
        at = np.sort(np.array(kept, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (image, det, truth)], names=["image_id", "det_id", "annotation_id"])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    ordered = labelled.repartition("image_id", "root").sortWithinPartitions("image_id", "root", "det_id", "annotation_id")
    chosen = ordered.mapInArrow(_whole_groups(2, take), f"image_id {kinds['image_id']}, det_id {kinds['det_id']}, annotation_id {kinds['annotation_id']}")
    both = counted.filter(~alone).join(chosen, ["image_id", "det_id", "annotation_id"], "left_semi")
    return counted.filter(alone).unionByName(both).drop("__of_det", "__of_gt")
