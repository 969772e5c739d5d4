"""The grouped matcher, limits on detections and the assignment of least distance, against plain versions."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from boxlake.operators import assignment, matching, metrics

DET = "image_id bigint, file_name string, category_id int, det_id bigint, score double, x_min double, y_min double, x_max double, y_max double"
GT = "image_id bigint, file_name string, category_id int, annotation_id bigint, x_min double, y_min double, x_max double, y_max double"


def box(rng, side=200):
    x, y = rng.randint(0, side), rng.randint(0, side)
    return float(x), float(y), float(x + rng.randint(20, 80)), float(y + rng.randint(20, 80))


def crowd(seed, images=3, n=60, classes=2):
    rng = random.Random(seed)
    gts = [(i, f"i{i}", rng.randrange(classes), i * 1000 + k, *box(rng)) for i in range(images) for k in range(n)]
    near = lambda b: [v + rng.randint(-8, 8) for v in b]
    dets = [(i, f"i{i}", c, 2 * k + j, rng.choice([0.1, 0.5, 0.5, 0.9]), *map(float, near(b))) for (i, _, c, k, *b) in gts for j in range(rng.choice([0, 1, 2]))]
    return dets + [(7, "bare", 0, 99999, 0.5, 0.0, 0.0, 10.0, 10.0)], gts


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def brute_hits(dets, gts, threshold, most=None):
    out = {}
    for image, category in {(d[0], d[2]) for d in dets}:
        mine = sorted((d for d in dets if (d[0], d[2]) == (image, category)), key=lambda d: (-d[4], d[3]))[:most]
        free = {g[3]: g for g in gts if (g[0], g[2]) == (image, category)}
        for d in mine:
            clipped = [max(v, 0) for v in d[5:]]
            options = [(-iou(clipped, g[4:]), k) for k, g in free.items() if iou(clipped, g[4:]) >= threshold]
            out[d[3]] = int(bool(options))
            if options:
                del free[min(options)[1]]
    return out


@pytest.mark.parametrize("crowded, most", [(None, None), (0, None), (25, None), (None, 7), (0, 7), (5, 7)])
def test_grouped_matcher_is_the_fold(spark, crowded, most):
    dets, gts = crowd(1)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    rows = metrics.greedy_hits(d, g, (0.4, 0.7), most, crowded).collect()
    for t in (0.4, 0.7):
        assert {r.det_id: r.hit for r in rows if r.threshold == t} == brute_hits(dets, gts, t, most)
    assert len(rows) == 2 * len(brute_hits(dets, gts, 0.4, most))


def test_crowded_ap_is_the_folds(spark):
    dets, gts = crowd(2)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    key = lambda r: (r.image_id, r.category_id, r.threshold)
    want = {key(r): r.ap for r in metrics.image_class_ap(d, g, max_detections=None).collect()}
    for crowded in (0, 30):
        assert {key(r): r.ap for r in metrics.image_class_ap(d, g, max_detections=None, crowded=crowded).collect()} == pytest.approx(want)


@pytest.mark.parametrize("crowded", [None, 20])
def test_all_detections_count_unless_limited(spark, crowded):
    """150 perfect detections of a class in one image."""
    gts = [(1, "a", 0, k, 30.0 * k, 0.0, 30.0 * k + 20, 20.0) for k in range(150)]
    dets = [(1, "a", 0, k, (k + 1) / 200, *b) for (_, _, _, k, *b) in gts]
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    curve = metrics.pr_curve(d, g, crowded=crowded).collect()
    assert len(curve) == 150 and max(r.recall for r in curve) == 1
    assert max(r.recall for r in metrics.pr_curve(d, g, max_detections=100, crowded=crowded).collect()) == pytest.approx(2 / 3)
    assert metrics.dataset_ap(d, g, (0.5,), crowded=crowded).first().ap == pytest.approx(67 / 101)
    assert metrics.dataset_ap(d, g, (0.5,), max_detections=None, crowded=crowded).first().ap == pytest.approx(1)
    assert metrics.image_ap(d, g, max_detections=None, crowded=crowded).first().map50 == pytest.approx(1)
    with pytest.raises(ValueError):
        metrics.pr_curve(d, g, max_detections=0)


def test_an_image_of_50000_boxes(spark):
    ids = spark.range(50_000)
    x, y = (F.col("id") % 250) * 20, F.floor(F.col("id") / 250) * 20
    place = [F.lit(1).cast("bigint").alias("image_id"), F.lit("a").alias("file_name"), F.lit(0).alias("category_id")]
    corners = lambda by: [(x + by).cast("double").alias("x_min"), (y + by).cast("double").alias("y_min"), (x + 24 + by).cast("double").alias("x_max"), (y + 24 + by).cast("double").alias("y_max")]
    gts = ids.select(*place, F.col("id").alias("annotation_id"), *corners(0))
    dets = ids.select(*place, F.col("id").alias("det_id"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("score"), *corners(2))
    began = time.time()
    hits = metrics.greedy_hits(dets, gts, (0.5,), crowded=1000).agg(F.sum("hit"), F.count(F.lit(1))).first()
    assert tuple(hits) == (50_000, 50_000) and time.time() - began < 120


def brute_assignment(edges):
    best = (0, 0.0)
    for n in range(min(len({e[0] for e in edges}), len({e[1] for e in edges})), 0, -1):
        sums = [sum(e[2] for e in some) for some in itertools.combinations(edges, n) if len({e[0] for e in some}) == len({e[1] for e in some}) == n]
        if sums:
            return n, min(sums)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_assignment(seed):
    rng = random.Random(seed)
    pairs = rng.sample([(a, b) for a in range(4) for b in range(4)], rng.randint(1, 12))
    edges = [(a, b + 100, float(rng.choice([0, 1, 1, 2, 3, 5, 8]))) for a, b in pairs]
    taken = [edges[k] for k in assignment.assigned(edges)]
    assert len({e[0] for e in taken}) == len({e[1] for e in taken}) == len(taken)
    n, total = brute_assignment(edges)
    assert (len(taken), sum(e[2] for e in taken)) == (n, pytest.approx(total))


def test_a_detection_tries_its_second_truth(spark):
    """Both detections are nearest to one ground truth: the farther one goes to the other, which mutual best would lose."""
    at = lambda x: (float(x - 5), 0.0, float(x + 5), 10.0)
    gts = [(1, "a", 0, 1, *at(100)), (1, "a", 0, 2, *at(112)), (2, "b", 0, 3, *at(50)), (3, "c", 0, 4, *at(50)), (3, "c", 1, 5, *at(50))]
    dets = [(1, "a", 0, 10, 0.5, *at(101)), (1, "a", 0, 11, 0.9, *at(103)), (2, "b", 0, 12, 0.5, *at(90)), (3, "c", 0, 13, 0.5, *at(52)), (3, "c", 0, 14, 0.5, *at(51))]
    rows = metrics.point_matches(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), 15).collect()
    assert {(r.det_id, r.annotation_id) for r in rows} == {(10, 1), (11, 2), (14, 4)}
    point = metrics.point_metrics(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), 15).orderBy("category_id").first()
    assert (point.tp, point.fp, point.fn) == (3, 2, 1)


def test_assignment_of_a_crowd(spark):
    """Lines of points, each detection half way between two truths: all are matched, at the distance that is known."""
    at = lambda x, y: (float(x - 1), float(y - 1), float(x + 1), float(y + 1))
    gts = [(i, "a", 0, 1000 * i + k, *at(20 * k, 100)) for i in range(3) for k in range(200)]
    dets = [(i, "a", 0, 1000 * i + k, 0.5, *at(20 * k + 11, 100)) for i in range(3) for k in range(200)]
    rows = metrics.point_matches(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), 12).collect()
    assert len(rows) == 600 and sum(math.sqrt(r.value) for r in rows) == pytest.approx(600 * 11)


def test_crowded_images_are_matched_without_their_pairs(spark):
    """Boxes that all overlap each other: what is dealt out goes with the boxes, and a task gets none of the 4 million pairs."""
    ids = spark.range(2000)
    place = [F.lit(1).cast("bigint").alias("image_id"), F.lit("a").alias("file_name"), F.lit(0).alias("category_id")]
    corners = lambda by: [(F.col("id") % 7 + by).cast("double").alias(c) for c in ("x_min", "y_min")] + [(F.col("id") % 5 + 900 + by).cast("double").alias(c) for c in ("x_max", "y_max")]
    gts = ids.select(*place, F.col("id").alias("annotation_id"), *corners(0))
    dets = ids.select(*place, F.col("id").alias("det_id"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("score"), *corners(1))
    assert metrics.greedy_hits(dets, gts, (0.5,), crowded=10).agg(F.sum("hit")).first()[0] == 2000
    assert "Join" not in metrics._crowded_hits(dets, gts, (0.5,))._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_by_cells_come_once_without_a_second_deal(spark):
    rows = [(1, "a", 0, k, 0.5, -30.0 + 17 * k, 5.0 * k, 60.0 + 17 * k, 90.0 + 5 * k) for k in range(40)]
    d = spark.createDataFrame(rows, DET)
    g = spark.createDataFrame([(i, f, c, k, *b) for i, f, c, k, _, *b in rows], GT)
    cells = matching.pairs(d, g, cell=32)
    want = {(r.det_id, r.annotation_id): r.value for r in matching.pairs(d, g).collect() if r.value > 0}
    got = [((r.det_id, r.annotation_id), r.value) for r in cells.collect() if r.value > 0]
    assert len(got) == len(want) and dict(got) == want
    assert "Aggregate" not in cells._jdf.queryExecution().optimizedPlan().toString()
