"""Greedy suppression and merging of overlapping boxes within an image, as folds over sorted arrays.

A fold sees one image's boxes (of a class, if classes are told apart). ``nms`` can take images with more
than ``crowded`` boxes through a function of the same result that reads runs of images in Arrow batches instead, and
``lsnms`` splits an image into groups of boxes that touch the same cells before it folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.functions import boxes
from boxlake.operators.assignment import _starts, _whole_groups
from boxlake.operators.components import components
from boxlake.operators.conversions import tile_to_image_coords
from boxlake.sources.shared import written

BOX = ("x_min", "y_min", "x_max", "y_max")
#: Boxes of a group up to which they are walked one by one, and of an image up to which they are folded whole.
FEW = 32


def _keys(df: DataFrame, per_class: bool) -> list[str]:
    return ["image_id", "category_id"] if per_class else ["image_id"]


def _boxes_of(keys: list[str], df: DataFrame, order: Column, extra: tuple[str, ...]) -> DataFrame:
    item = F.struct(order.alias("neg"), "det_id", *(F.col(c).cast("double").alias(c) for c in BOX), *extra)
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with __place from 1, its groups unbroken, in their order, on any partitioning. A function of Arrow batches that needs groups
    whole must read __place: Spark takes a ``repartition`` for done by a bucketed table's partitioning and then splits its buckets by files,
    since nothing above asks for them. A window asks."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(-F.col("score"), "det_id")))


def _kept_ids(keys: list[str], df: DataFrame, order: Column, threshold: float, how: Callable) -> DataFrame:
    grouped = _boxes_of(keys, df, order, ())
    none = F.filter("items", lambda b: F.lit(False))

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: how(boxes.fields(k), boxes.fields(b)) > threshold)
        return F.when(clash, kept).otherwise(F.array_append(kept, b))

    kept = F.aggregate("items", none, step)
    return grouped.select(keys[0], F.explode(kept).alias("b")).select(keys[0], "b.det_id")


def _streamed_nms(keys: int, threshold: float) -> Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]:
    """Use of runs of whole groups (key columns, det_id, corners and others, by falling score): the rows that stay. Small groups, of which
    there are millions, are walked as numbers; in large ones a box meets all that follow it at once."""

    def few(x0: list, y0: list, x1: list, y1: list) -> list[int]:
        kept: list[tuple] = []
        for i in range(len(x0)):
            a, b, c, d = x0[i], y0[i], x1[i], y1[i]
            area = (c - a) * (d - b)
            for _, e, f, g, h, other in kept:
                w, t = min(c, g) - max(a, e), min(d, h) - max(b, f)
                if w > 0 and t > 0 and w * t / (other + area - w * t) > threshold:
                    break
            else:
                kept.append((i, a, b, c, d, area))
        return [k[0] for k in kept]

    def many(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[int]:
        area, alive, kept = (x1 - x0) * (y1 - y0), np.ones(len(x0), bool), []
        for i in range(len(x0)):
            if alive[i]:
                kept.append(i)
                w = np.minimum(x1[i], x1[i + 1 :]) - np.maximum(x0[i], x0[i + 1 :])
                h = np.minimum(y1[i], y1[i + 1 :]) - np.maximum(y0[i], y0[i + 1 :])
                shared = np.maximum(w, 0) * np.maximum(h, 0)
                union = area[i] + area[i + 1 :] - shared
                alive[i + 1 :] &= ~(np.divide(shared, union, out=np.zeros_like(shared), where=union != 0) > threshold)
        return kept

    def run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts, sides, kept = _starts(*rows[:keys]), rows[keys + 1 : keys + 5], []
        plain = [s.tolist() for s in sides]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            small = b - a <= FEW and threshold >= 0
            kept += [a + k for k in (few(*(s[a:b] for s in plain)) if small else many(*(s[a:b] for s in sides)))]
        at = np.array(kept, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0][at]), pa.array(rows[keys][at])], names=["image_id", "det_id"])

    return run


def nms(dets: DataFrame, threshold: float = 0.5, per_class: bool = False, measure: str | Callable = "iou", crowded: int | None = None) -> DataFrame:
    """The detections left when each, by falling score (then det_id), drops those after it that overlap it more
    than threshold."""
    keys, how = _keys(dets, per_class), boxes.measure(measure)
    neg = -F.col("score")
    if crowded is None:
        kept = _kept_ids(keys, dets, neg, threshold, how)
    else:
        if measure != "iou":
            raise ValueError("crowded images are folded by IoU only")
        sizes = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        counted = dets.join(sizes, keys)
        small = _kept_ids(keys, counted.filter(F.col("__n") <= crowded), neg, threshold, how)
        schema = T.StructType([dets.schema["image_id"], dets.schema["det_id"]])
        ordered = _placed(counted.filter(F.col("__n") > crowded), keys)
        large = ordered.select(*keys, "det_id", *(F.col(c).cast("double").alias(c) for c in BOX), "__place").mapInArrow(_whole_groups(len(keys), _streamed_nms(len(keys), threshold)), schema)
        kept = small.unionByName(large)
    return dets.join(kept, ["image_id", "det_id"], "left_semi")


def first_box_wins(gts: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Overlapping labels without scores: the one with the smallest annotation_id stays."""
    kept = _kept_ids(["image_id"], gts.withColumnRenamed("annotation_id", "det_id"), F.lit(0.0), threshold, boxes.iou)
    return gts.join(kept.withColumnRenamed("det_id", "annotation_id"), ["image_id", "annotation_id"], "left_semi")


def merged(dets: DataFrame, threshold: float = 0.5, per_class: bool = False, measure: str | Callable = "ios") -> DataFrame:
    """Greedy merging: each detection, by falling score, joins the first kept box that it overlaps more than
    threshold; the kept box becomes their union and keeps its id and highest score. Gives image_id,
    det_id, score and the box."""
    keys, how = _keys(dets, per_class), boxes.measure(measure)
    grouped = _boxes_of(keys, dets, -F.col("score"), ())
    none = F.filter("items", lambda b: F.lit(False))

    def step(kept: Column, b: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: how(boxes.fields(k), boxes.fields(b)) > threshold), F.lit(True)).cast("int")
        union = lambda k: F.struct(k["neg"].alias("neg"), k["det_id"].alias("det_id"), F.least(k["x_min"], b["x_min"]).alias("x_min"), F.least(k["y_min"], b["y_min"]).alias("y_min"), F.greatest(k["x_max"], b["x_max"]).alias("x_max"), F.greatest(k["y_max"], b["y_max"]).alias("y_max"))
        grown = F.transform(kept, lambda k, i: F.when(i == at - 1, union(k)).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.array_append(kept, b))

    folded = grouped.select(*keys, F.explode(F.aggregate("items", none, step)).alias("b"))
    return folded.select(*keys, "b.det_id", (-F.col("b.neg")).alias("score"), *(F.col(f"b.{c}").alias(c) for c in BOX))


def merge_tile_detections(dets: DataFrame, method: str = "nms", threshold: float = 0.5, measure: str = "ios") -> DataFrame:
    """Detections in tiles (with the tile's x0, y0) as detections of the image: moved, then suppressed, merged
    or just put together."""
    moved = tile_to_image_coords(dets)
    if method == "concat":
        return moved
    if method == "nms":
        return nms(moved, threshold, measure=measure)
    if method == "nmm":
        return merged(moved, threshold, measure=measure)
    raise ValueError(f"method must be nms, nmm or concat, not {method!r}")


def _patched(dets: DataFrame, cell: int) -> DataFrame:
    """dets with patch: the smallest det_id of the boxes that cells they touch connect it with; null in images of FEW boxes at most,
    which are one group, so that only crowded images are searched for patches; without such images nothing is joined."""
    crowds = written(dets.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("image_id"))
    if crowds.isEmpty():
        return dets.withColumn("patch", F.lit(None).cast(dets.schema["det_id"].dataType))
    all_dets = dets.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("image_id")))
    dets = all_dets.filter((F.col("__n") > FEW) & reduce(Column.__and__, (F.abs(F.col(c)) < float("inf") for c in BOX)))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    node = F.struct("image_id", "det_id")
    cells = dets.select("image_id", node.alias("b"), F.explode(span("x_min", "x_max")).alias("cx"), "y_min", "y_max").select("image_id", "b", "cx", F.explode(span("y_min", "y_max")).alias("cy"))
    first = cells.groupBy("image_id", "cx", "cy").agg(F.min("b").alias("a"))
    patches = components(cells.join(first, ["image_id", "cx", "cy"]).select("a", "b"))
    label = patches.select("node.*", F.col("root.det_id").alias("patch"))
    joined = all_dets.join(label, ["image_id", "det_id"], "left")
    return joined.withColumn("patch", F.when(F.col("__n") > FEW, F.coalesce("patch", "det_id"))).drop("__n")


def lsnms(dets: DataFrame, threshold: float = 0.5, cell: int = 256) -> DataFrame:
    """nms for images with very many boxes. Boxes of one connected patch of cells (of images with more than FEW) are folded together; patches
    share no cell, so no overlap crosses them and the result is that of nms."""
    kept = _kept_ids(["image_id", "patch"], _patched(dets, cell), -F.col("score"), threshold, boxes.iou)
    return dets.join(kept, ["image_id", "det_id"], "left_semi")


def rotated_iou(a: Column, b: Column) -> Column:
    """IoU of two rotated boxes given as corner arrays."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    areas = boxes.bound(pair, lambda p: F.struct(boxes.polygon_area(boxes.clipped_polygon(p["a"], p["b"])).alias("shared"), (boxes.polygon_area(p["a"]) + boxes.polygon_area(p["b"])).alias("both")))
    return boxes.bound(areas, lambda s: F.coalesce(F.try_divide(s["shared"], s["both"] - s["shared"]), F.lit(0.0)))


def _cornered(df: DataFrame) -> DataFrame:
    return df.withColumn("corners", boxes.rotated_corners(*(F.col(c).cast("double") for c in ("cx", "cy", "w", "h", "angle"))))


def _hulls(df: DataFrame) -> DataFrame:
    """The upright box around corners, as x_min, y_min, x_max, y_max."""
    side = lambda end, axis: end(F.transform("corners", lambda p: p[axis]))
    return df.withColumns({"x_min": side(F.array_min, "x"), "y_min": side(F.array_min, "y"), "x_max": side(F.array_max, "x"), "y_max": side(F.array_max, "y")})


def _areas(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of polygons, a row each whose first size corners count; 0 with fewer than 3."""
    k = np.arange(x.shape[1])
    after = np.where(k + 1 < size[:, None], k + 1, 0)
    cross = x * np.take_along_axis(y, after, 1) - np.take_along_axis(x, after, 1) * y
    return np.where(size >= 3, np.abs(np.where(k < size[:, None], cross, 0.0).sum(axis=1)) / 2, 0.0)


def _rotated_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of rows of boxes (8 columns: x and y of the corners in turn), as ``rotated_iou`` has it: the edges of b cut a one after
    another, in all rows at once."""
    x, y, ex, ey = a[:, 0::2], a[:, 1::2], b[:, 0::2], b[:, 1::2]
    four = np.full(len(a), 4)
    both, size = _areas(x, y, four) + _areas(ex, ey, four), four
    for k in range(4):
        x0, y0, x1, y1 = (e[:, i, None] for i in (k, (k + 1) % 4) for e in (ex, ey))
        place = np.arange(x.shape[1])
        real, after = place < size[:, None], np.where(place + 1 < size[:, None], place + 1, 0)
        side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        after_x, after_y, after_side = (np.take_along_axis(v, after, 1) for v in (x, y, side))
        inside = side >= 0
        crosses = real & (inside != (after_side >= 0))
        t = np.divide(side, side - after_side, out=np.zeros_like(side), where=crosses)
        put = np.stack([real & inside, crosses], axis=2).reshape(len(a), -1)
        to = np.cumsum(put, axis=1) - 1
        size = to[:, -1] + 1
        row, at = np.nonzero(put)
        width = max(int(size.max(initial=0)), 1)
        cut = []
        for v, w in ((x, after_x), (y, after_y)):
            out = np.zeros((len(a), width))
            out[row, to[row, at]] = np.stack([v, v + t * (w - v)], axis=2).reshape(len(a), -1)[row, at]
            cut.append(out)
        x, y = cut
    shared = _areas(x, y, size)
    return np.divide(shared, both - shared, out=np.zeros_like(shared), where=both != shared)


def rotated_pairs(dets: DataFrame, gts: DataFrame) -> DataFrame:
    """image_id, det_id, annotation_id, value: IoU of rotated boxes (cx, cy, w, h, angle) of one image whose hulls overlap. Areas are
    clipped only for those, in Arrow batches."""
    d = _hulls(_cornered(dets)).select("image_id", "det_id", F.col("corners").alias("d"), *(F.col(c).alias(f"d_{c}") for c in BOX))
    g = _hulls(_cornered(gts)).select("image_id", "annotation_id", F.col("corners").alias("g"), *(F.col(c).alias(f"g_{c}") for c in BOX))
    near = d.join(g, "image_id").filter("d_x_min < g_x_max AND g_x_min < d_x_max AND d_y_min < g_y_max AND g_y_min < d_y_max")
    ids = ("image_id", "det_id", "annotation_id")
    corners = [F.col(side)[k][axis].alias(f"{side}{k}{axis}") for side in "dg" for k in range(4) for axis in "xy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 19)], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(_rotated_ious(sides[:, :8], sides[:, 8:]))], names=[*ids, "value"])

    chosen = near.select(*ids, *corners)
    return chosen.mapInArrow(run, T.StructType([*(chosen.schema[c] for c in ids), T.StructField("value", T.DoubleType())]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows of ``_placed`` as runs of whole groups, with all columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("__place").to_numpy() == 1)
        if len(starts):
            if sum(b.num_rows for b in held) + starts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


#: Pairs of rotated boxes that are clipped together, and boxes of a crowd that meet those kept before them at once.
_CLIPPED, _BLOCK = 1 << 14, 256


class _Turned:
    """Rotated boxes, in the order in which they are folded. A box drops those after it that overlap it more than the threshold."""

    def __init__(self, rows: pa.Table, threshold: float):
        cx, cy, w, h, c, s = (rows.column(k).to_numpy() for k in ("__cx", "__cy", "__w", "__h", "__cos", "__sin"))
        spots = ((-1, -1), (1, -1), (1, 1), (-1, 1))
        self.corners = np.stack([v for i, j in spots for v in (cx + i * w / 2 * c - j * h / 2 * s, cy + i * w / 2 * s + j * h / 2 * c)], axis=1)
        x, y = self.corners[:, 0::2], self.corners[:, 1::2]
        self.hull, self.threshold = (x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)), threshold

    def clashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a first) overlap more than the threshold. Only pairs whose hulls overlap are clipped."""
        x0, y0, x1, y1 = self.hull
        near = (x0[a] < x1[b]) & (x0[b] < x1[a]) & (y0[a] < y1[b]) & (y0[b] < y1[a])
        if self.threshold < 0:
            near[:] = True
        at = np.flatnonzero(near)
        for k in range(0, len(at), _CLIPPED):
            some = at[k : k + _CLIPPED]
            near[some] = _rotated_ious(self.corners[a[some]], self.corners[b[some]]) > self.threshold
        return near

    def kept_of_small(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rows that stay of many groups of FEW boxes at most; a row's place in its group is told."""
        first, second = [], []
        for k in range(1, int(place.max(initial=1))):  # pairs k places apart
            b = rows[place > k]
            clash = self.clashes(b - k, b)
            first.append((b - k)[clash])
            second.append(b[clash])
        gone: set[int] = set()
        if first:
            a, b = np.concatenate(first), np.concatenate(second)
            order = np.argsort(a, kind="stable")
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                if i not in gone:
                    gone.add(j)
        return rows[~np.isin(rows, np.fromiter(gone, np.int64, len(gone)))]

    def kept_of_crowd(self, start: int, end: int) -> np.ndarray:
        """The rows that stay of one large group: a block of boxes meets those kept before it, and what is left of it itself."""
        parts: list[np.ndarray] = []
        for at in range(start, end, _BLOCK):
            block = np.arange(at, min(at + _BLOCK, end))
            for before in parts:
                alive = ~self.clashes(np.repeat(before, len(block)), np.tile(block, len(before))).reshape(len(before), -1).any(axis=0)
                block = block[alive]
            parts.append(self.kept_of_small(block, np.arange(1, len(block) + 1)))
        return np.concatenate(parts)


def rotated_nms(dets: DataFrame, threshold: float = 0.5, cell: int | None = None) -> DataFrame:
    """nms of boxes cx, cy, w, h, angle (radians), per image. With cell, a crowded image's boxes are folded by connected patches of cells
    that their hulls touch, as in ``lsnms``, with the same result. Polygons are clipped in Arrow batches, those of many images at once, and
    rows pass whole, so nothing is joined back. Boxes with a side that is null or not finite overlap nothing; rows without
    image_id or det_id are left out."""
    sides = ("cx", "cy", "w", "h")
    packed = dets.filter("image_id IS NOT NULL AND det_id IS NOT NULL").select(F.struct(*(F.col(f"`{c}`") for c in dets.columns)).alias("__row"), "image_id", "det_id", "score", *(F.col(c).cast("double").alias(c) for c in (*sides, "angle")))
    placed = _placed(_patched(_hulls(_cornered(packed)), cell), ["image_id", "patch"]) if cell else _placed(packed, ["image_id"])
    ready = placed.select("__row", *(F.col(c).alias(f"__{c}") for c in sides), F.cos("angle").alias("__cos"), F.sin("angle").alias("__sin"), "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            place = rows.column("__place").to_numpy()
            starts = np.append(np.flatnonzero(place == 1), len(place))
            boxes_of, size, turned = np.arange(len(place)), np.repeat(np.diff(starts), np.diff(starts)), _Turned(rows, threshold)
            small = size <= FEW
            kept = [turned.kept_of_small(boxes_of[small], place[small])]
            kept += [turned.kept_of_crowd(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if b - a > FEW]
            at = np.sort(np.concatenate(kept))
            for batch in rows.select(["__row"]).take(pa.array(at)).to_batches():
                yield pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=columns)

    columns = dets.columns
    return ready.mapInArrow(run, dets.schema)
