"""Images whole in one task, however their tables lie, and crowds of boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.operators import assignment, selection, suppression
from boxlake.sources import shared
from boxlake.sources.shared import written_in_buckets


def dets(spark, *rows):
    return spark.createDataFrame([(k, i, f"i{i}.jpg", 1000, 1000, c, *b, float(s)) for k, i, c, b, s in rows], schemas.DETECTIONS)


def piled(spark, n=900, images=40):
    """Boxes that overlap, many to an image."""
    return dets(spark, *[(k, k % images, 0, (7 * k % 50, 5 * k % 40, 7 * k % 50 + 60, 5 * k % 40 + 60), k % 90 / 100) for k in range(n)])


def in_split_buckets(spark, df):
    """df in as many buckets as there are shuffle partitions, several files to a bucket."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = written_in_buckets(df.repartition(3 * n, "det_id"), "image_id", n)
    assert len(out.inputFiles()) > 2 * n
    return out


def test_crowded_suppression_of_a_table_in_buckets(spark):
    d = piled(spark)
    assert {r.det_id for r in suppression.nms(in_split_buckets(spark, d), 0.3, crowded=3).collect()} == {r.det_id for r in suppression.nms(d, 0.3).collect()}


def turned(df):
    """The boxes about their centres, each at an angle of its own."""
    mid = lambda a, b: ((F.col(a) + F.col(b)) / 2).cast("double")
    return df.select("det_id", "image_id", "score", mid("x_min", "x_max").alias("cx"), mid("y_min", "y_max").alias("cy"), (F.col("x_max") - F.col("x_min")).alias("w"), (F.col("y_max") - F.col("y_min")).alias("h"), (F.col("det_id") % 11 / 4).alias("angle"), F.array(F.struct("file_name", "category_id")).alias("others"))


def folded(rows, threshold):
    """The greedy fold, box by box, over the measure of ``rotated_pairs``."""
    by_image, kept = {}, set()
    for r in sorted(rows, key=lambda r: (-r.score, r.det_id)):
        by_image.setdefault(r.image_id, []).append(r)
    for found in by_image.values():
        ends = np.array([[v for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for v in (r.cx + i * r.w / 2 * math.cos(r.angle) - j * r.h / 2 * math.sin(r.angle), r.cy + i * r.w / 2 * math.sin(r.angle) + j * r.h / 2 * math.cos(r.angle))] for r in found])
        stay = []
        for k in range(len(found)):
            if not stay or not (suppression._rotated_ious(ends[stay], np.repeat(ends[k : k + 1], len(stay), axis=0)) > threshold).any():
                stay.append(k)
        kept |= {found[k].det_id for k in stay}
    return kept


@pytest.mark.parametrize("cell", [None, 16])
@pytest.mark.parametrize("n, images", [(900, 90), (900, 2), (300, 1)])
def test_rotated_suppression_in_batches(spark, n, images, cell):
    """Small images and crowds, in split buckets too; columns pass through, and no fold of Catalyst's is run over pairs."""
    d = turned(piled(spark, n, images))
    found = suppression.rotated_nms(in_split_buckets(spark, d), 0.3, cell)
    rows = found.collect()
    assert {r.det_id for r in rows} == folded(d.collect(), 0.3) and 0 < len(rows) < n
    assert found.columns == d.columns and all(r.others[0].file_name == f"i{r.image_id}.jpg" for r in rows)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rotated_boxes_without_sides(spark):
    """Sides that are null or not finite overlap nothing; without boxes there is nothing."""
    apart = [(100 + k, 1, 0.5, 50.0 * (k + 1), 0.0, 9.0, 9.0, 0.0) for k in range(40)]  # a crowd
    rows = [(1, 1, 0.9, 0.0, 0.0, 9.0, 9.0, 0.0), (2, 1, 0.8, 0.0, 0.0, 9.0, 9.0, 0.0), (3, 1, 0.7, None, 0.0, 9.0, 9.0, 0.0), (4, 1, 0.95, float("nan"), 0.0, 9.0, 9.0, 0.0), (5, None, 0.9, 0.0, 0.0, 9.0, 9.0, 0.0), (6, 1, 0.6, float("inf"), 0.0, 9.0, 9.0, 0.0), *apart]
    d = spark.createDataFrame(rows, "det_id bigint, image_id bigint, score double, cx double, cy double, w double, h double, angle double")
    for cell in (None, 8):
        assert sorted(r.det_id for r in suppression.rotated_nms(d, 0.5, cell).collect()) == [1, 3, 4, 6, *(r[0] for r in apart)]
        assert suppression.rotated_nms(d.filter("det_id < 0"), 0.5, cell).count() == 0


def pile(n, seed=3):
    """So many truths and detections on one image of fixed size: the more there are, the denser they lie."""
    rng = np.random.default_rng(seed)
    corner, size = rng.integers(0, 1000, (2, n)), rng.integers(20, 80, (2, n))
    truth = np.concatenate([corner, corner + size]).astype(float)
    return rng.permutation(n), truth, truth[:, rng.integers(0, n, n)] + rng.integers(-8, 9, (4, n))


def greedy(ids, truth, found, threshold):
    taken, out = np.zeros(len(ids), bool), []
    for box in found.T:
        w, h = (np.maximum(np.minimum(box[k + 2], truth[k + 2]) - np.maximum(box[k], truth[k]), 0) for k in (0, 1))
        area = (truth[2] - truth[0]) * (truth[3] - truth[1])
        value = np.where(taken, -1, w * h / ((box[2] - box[0]) * (box[3] - box[1]) + area - w * h))
        best = min(np.flatnonzero(value == value.max()), key=lambda k: ids[k])
        out.append(int(value[best] >= threshold))
        taken[best] |= bool(out[-1])
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.7, 0.95])
@pytest.mark.parametrize("n", [7, 2000])
def test_crowd_is_matched_as_box_by_box(threshold, n):
    ids, truth, found = pile(n)
    found[2:] = np.maximum(found[2:], found[:2] + 1)
    assert assignment._Crowd(ids, truth, threshold).hits(found).tolist() == greedy(ids, truth, found, threshold)


def test_copies_of_a_box_are_taken_by_id():
    """More equal options than are kept for a detection."""
    ids, truth = np.arange(500)[::-1].copy(), np.tile([[0.0], [0.0], [9.0], [9.0]], 500)
    assert assignment._Crowd(ids, truth, 0.5).hits(np.tile([[0.0], [0.0], [9.0], [9.0]], 600)).tolist() == [1] * 500 + [0] * 100


def test_what_a_detection_looks_at_grows_less_than_the_crowd():
    looked = []
    for n in (4_000, 64_000):
        ids, truth, found = pile(n)
        crowd = assignment._Crowd(ids, truth, 0.4)
        crowd.hits(found)
        looked.append(crowd.looked_at / n)
    assert looked[1] < 8 * looked[0]  # 16 times before, as there are 16 times the boxes around


def test_match_rows_of_tables_in_buckets(spark, monkeypatch):
    """The rows are those of tables without buckets, and nothing that is paired is dealt out again."""
    d = piled(spark)
    box = lambda k: (7 * k % 50 + 3, 5 * k % 40, 7 * k % 50 + 63, 5 * k % 40 + 60)
    g = spark.createDataFrame([(k, k % 30, f"i{k % 30}.jpg", 1000, 1000, k % 2, *box(k)) for k in range(400)], schemas.GROUND_TRUTH)
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    whole = lambda df: written_in_buckets(df.repartition(n, "image_id"), "image_id", n)
    dealt_d, dealt_g = whole(d), whole(g)
    plans, made = [], selection.written

    def seen(df, together=False):
        with shared._set(spark, **{shared._ALL_KEYS: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        return made(df, together)

    monkeypatch.setattr(selection, "written", seen)
    found = selection.match_rows(dealt_d, dealt_g)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    rows = key(found)
    # the pairs were written, and pairs, rows and precision dealt out by more than the image; the union of matches still is dealt out by image
    assert len(plans) == 1 and "pred_det_id" in plans[0] and plans[0].count("Exchange hashpartitioning") <= 1
    assert rows == key(selection.match_rows(d, g)) != []
