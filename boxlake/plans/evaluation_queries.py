"""Queries on matching, scores, selection and sampling of hard images."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from boxlake.operators import labels, matching, metrics, selection, stats, suppression
from boxlake.plans.fixtures import with_tables
from boxlake.plans.registry import Registry

R = Registry()
N_CLASSES = 6


def _iou(a: str, b: str) -> str:
    shared = f"(greatest(least({a}x_max, {b}x_max) - greatest({a}x_min, {b}x_min), 0e0) * greatest(least({a}y_max, {b}y_max) - greatest({a}y_min, {b}y_min), 0e0))"
    area = lambda p: f"(CAST({p}x_max - {p}x_min AS DOUBLE) * ({p}y_max - {p}y_min))"
    return f"({shared} / ({area(a)} + {area(b)} - {shared}))"


def _ios(a: str, b: str) -> str:
    shared = f"(greatest(least({a}x_max, {b}x_max) - greatest({a}x_min, {b}x_min), 0e0) * greatest(least({a}y_max, {b}y_max) - greatest({a}y_min, {b}y_min), 0e0))"
    area = lambda p: f"(CAST({p}x_max - {p}x_min AS DOUBLE) * ({p}y_max - {p}y_min))"
    return f"({shared} / least({area(a)}, {area(b)}))"


GT, DET = "g.", "d."
#: Pairs with their CIoU, after negative coordinates of detections have been set to 0.
CIOU = f"""{with_tables("fx_gt", "fx_det")},
d AS (SELECT det_id, image_id, file_name, category_id, score, greatest(x_min, 0) AS x_min, greatest(y_min, 0) AS y_min, greatest(x_max, 0) AS x_max, greatest(y_max, 0) AS y_max FROM fx_det),
g AS (SELECT annotation_id, image_id, file_name, category_id, x_min, y_min, x_max, y_max FROM fx_gt),
v AS (
  SELECT d.image_id, d.file_name, d.det_id, g.annotation_id, {_iou(DET, GT)} AS iou,
    power((d.x_min + d.x_max - g.x_min - g.x_max) / 2e0, 2) + power((d.y_min + d.y_max - g.y_min - g.y_max) / 2e0, 2) AS apart,
    power(greatest(d.x_max, g.x_max) - least(d.x_min, g.x_min), 2) + power(greatest(d.y_max, g.y_max) - least(d.y_min, g.y_min), 2) AS diagonal,
    {4 / math.pi**2!r}e0 * power(atan(CAST(d.x_max - d.x_min AS DOUBLE) / (d.y_max - d.y_min)) - atan(CAST(g.x_max - g.x_min AS DOUBLE) / (g.y_max - g.y_min)), 2) AS turn
  FROM d JOIN g ON d.image_id = g.image_id),
c AS (SELECT *, iou - apart / (diagonal + 1e-7) - turn * turn / (1 - iou + turn + 1e-7) AS ciou FROM v),
best AS (SELECT image_id, file_name, det_id, max(ciou) AS best_ciou, arg_min(annotation_id, (-ciou, annotation_id)) AS annotation_id FROM c GROUP BY ALL),
matches AS (
  SELECT image_id, file_name, det_id, best_ciou, CASE WHEN best_ciou >= 0.4e0 THEN annotation_id END AS annotation_id,
    CAST(best_ciou >= 0.4e0 AS BIGINT) AS tp, CAST(best_ciou < 0.4e0 AS BIGINT) AS fp FROM best
  UNION ALL
  SELECT image_id, file_name, det_id, NULL, NULL, 0, count(*) OVER (PARTITION BY image_id) FROM fx_det WHERE image_id NOT IN (SELECT image_id FROM fx_gt)),
missed AS (
  SELECT g.image_id, g.file_name, g.annotation_id, CAST(1 AS BIGINT) AS fn FROM fx_gt g
  WHERE g.image_id IN (SELECT image_id FROM fx_det) AND coalesce((SELECT max(ciou) FROM c WHERE c.annotation_id = g.annotation_id), -9) < 0.4e0),
counts AS (
  SELECT image_id, file_name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
    SELECT image_id, file_name, tp, fp, 0 AS fn FROM matches UNION ALL SELECT image_id, file_name, 0, 0, fn FROM missed) GROUP BY ALL),
ratios AS (SELECT *, fp / (tp + 1e-8) AS fp_tp_ratio, fn / (tp + 1e-8) AS fn_tp_ratio FROM counts),
entropy AS (SELECT image_id, file_name, sum(CASE WHEN score > 0 THEN -score * ln(score) ELSE 0 END) AS uncertainty FROM fx_det GROUP BY ALL)"""


def _errors(det, gt):
    return matching.image_error_counts(matching.match_predictions(det, gt), matching.missed_ground_truth(det, gt))


R.add("match_predictions", "fx_det fx_gt", lambda d, g: matching.match_predictions(d, g).drop("image_id"), f"{CIOU}\nSELECT file_name, det_id, round(best_ciou, 6) + 0e0 AS best_ciou, annotation_id, tp, fp FROM matches")
R.add("match_predictions_cells", "fx_det fx_gt", lambda d, g: matching.match_predictions(d, g, cell=256).select("file_name", "det_id", "tp", "fp", "annotation_id"), f"{CIOU}\nSELECT file_name, det_id, tp, fp, annotation_id FROM matches")
R.add("missed_ground_truth", "fx_det fx_gt", lambda d, g: matching.missed_ground_truth(d, g).drop("image_id"), f"{CIOU}\nSELECT file_name, annotation_id, fn FROM missed")
R.add("image_error_counts", "fx_det fx_gt", lambda d, g: _errors(d, g).drop("image_id"), f"{CIOU}\nSELECT file_name, tp, fp, fn, round(fp_tp_ratio, 6) AS fp_tp_ratio, round(fn_tp_ratio, 6) AS fn_tp_ratio FROM ratios")
R.add(
    "hard_by_errors",
    "fx_det fx_gt",
    lambda d, g: selection.hard_by_errors(_errors(d, g)).join(selection.image_uncertainty(d), ["image_id", "file_name"], "left").select("file_name", "fp_tp_ratio", "fn_tp_ratio", "uncertainty"),
    f"{CIOU}\nSELECT file_name, round(fp_tp_ratio, 6) AS fp_tp_ratio, round(fn_tp_ratio, 6) AS fn_tp_ratio, round(uncertainty, 6) AS uncertainty FROM ratios LEFT JOIN entropy USING (image_id, file_name) WHERE fp_tp_ratio > 0.2e0 OR fn_tp_ratio > 0.2e0",
)
R.add("most_false_positives", "fx_det fx_gt", lambda d, g: selection.most_false_positives(_errors(d, g), 20).select("file_name", "fp"), f"{CIOU}\nSELECT file_name, fp FROM counts ORDER BY fp DESC, file_name LIMIT 20")
R.add("uncertainty_entropy", "fx_det", lambda d: selection.image_uncertainty(d).drop("image_id"), f"{CIOU}\nSELECT file_name, round(uncertainty, 6) AS uncertainty FROM entropy")
R.add("uncertainty_one_minus_p", "fx_det", lambda d: selection.image_uncertainty(d, "1-p").drop("image_id"), f"{with_tables('fx_det')}\nSELECT file_name, round(1 - avg(score), 6) AS uncertainty FROM fx_det GROUP BY file_name")
R.add(
    "image_score_profile",
    "fx_det",
    lambda d: selection.image_score_profile(d).drop("image_id", "all_scores"),
    f"{with_tables('fx_det')}\nSELECT file_name, count(*) AS n, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(var_pop(score), 6) + 0e0 AS var_score FROM fx_det GROUP BY file_name",
)
R.add("task_scores", "fx_det", stats.task_scores, f"{with_tables('fx_det')}\nSELECT file_name, count(*) AS n, round(max(score), 6) AS max_score FROM fx_det GROUP BY file_name")
R.add("max_detections", "fx_det", lambda d: labels.max_detections(d, 3).select("image_id", "det_id", "score"), f"{with_tables('fx_det')}\nSELECT image_id, det_id, round(score, 6) AS score FROM fx_det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 3")
R.add("score_at_least", "fx_det", lambda d: labels.score_at_least(d, 0.7).select("image_id", "det_id", "score"), f"{with_tables('fx_det')}\nSELECT image_id, det_id, round(score, 6) AS score FROM fx_det WHERE score >= 0.7e0")

# confusion and scores
_PAIRS = f"p AS (SELECT d.image_id, d.det_id, g.annotation_id, d.category_id AS det_class, g.category_id AS gt_class, {_iou(DET, GT)} AS iou FROM fx_det d JOIN fx_gt g ON d.image_id = g.image_id WHERE d.score SCORE)"
_MULTI = f"""{with_tables("fx_gt", "fx_det")},
{_PAIRS.replace("SCORE", ">= 0.3e0")},
h AS (SELECT * FROM p WHERE iou >= 0.5e0),
m AS (SELECT gt_class, pred_class, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT gt_class, det_class AS pred_class, count(*) AS n FROM h GROUP BY ALL
  UNION ALL SELECT 6, category_id, count(*) FROM fx_det WHERE score >= 0.3e0 AND det_id NOT IN (SELECT det_id FROM h) GROUP BY ALL
  UNION ALL SELECT category_id, 6, count(*) FROM fx_gt WHERE annotation_id NOT IN (SELECT annotation_id FROM h WHERE gt_class = det_class) GROUP BY ALL) GROUP BY ALL)"""
R.add("confusion_multi", "fx_det fx_gt", lambda d, g: matching.confusion_multi(d, g, N_CLASSES), f"{_MULTI}\nSELECT * FROM m")
R.add(
    "confusion_one_to_one",
    "fx_det fx_gt",
    lambda d, g: matching.confusion_one_to_one(d, g, N_CLASSES),
    f"""{with_tables("fx_gt", "fx_det")},
{_PAIRS.replace("SCORE", "> 0.25e0")},
f AS (SELECT * FROM p WHERE iou > 0.6e0 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, annotation_id) = 1),
h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY image_id, annotation_id ORDER BY iou DESC, det_id) = 1)
SELECT gt_class, pred_class, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT gt_class, det_class AS pred_class, count(*) AS n FROM h GROUP BY ALL
  UNION ALL SELECT 6, category_id, count(*) FROM fx_det WHERE score > 0.25e0 AND det_id NOT IN (SELECT det_id FROM h) GROUP BY ALL
  UNION ALL SELECT category_id, 6, count(*) FROM fx_gt WHERE annotation_id NOT IN (SELECT annotation_id FROM h) GROUP BY ALL) GROUP BY ALL""",
)
R.add(
    "class_scores",
    "fx_det fx_gt",
    lambda d, g: matching.class_scores(matching.confusion_multi(d, g, N_CLASSES), N_CLASSES),
    f"""{_MULTI},
a AS (SELECT gt_class AS class, sum(n) AS actual, coalesce(sum(n) FILTER (WHERE gt_class = pred_class), 0) AS tp FROM m GROUP BY 1),
q AS (SELECT pred_class AS class, sum(n) AS pred FROM m GROUP BY 1),
s AS (SELECT class, coalesce(tp, 0) / (coalesce(pred, 0) + 1e-8) AS p, coalesce(tp, 0) / (coalesce(actual, 0) + 1e-8) AS r FROM a FULL JOIN q USING (class) WHERE class < 6)
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r + 1e-8), 4) AS f1 FROM s""",
)

# suppression: the list of kept boxes is carried along the ranks
_RANKED = "r AS MATERIALIZED (SELECT image_id, ID AS id, CAST(x_min AS DOUBLE) AS x_min, CAST(y_min AS DOUBLE) AS y_min, CAST(x_max AS DOUBLE) AS x_max, CAST(y_max AS DOUBLE) AS y_max, SCORE AS score, row_number() OVER (PARTITION BY image_id ORDER BY ORDERED) AS k FROM SOURCE)"
_ITEM = "{'id': r.id, 'score': r.score, 'x_min': r.x_min, 'y_min': r.y_min, 'x_max': r.x_max, 'y_max': r.y_max}"


def _nms_sql(table: str, id_column: str, score: str, order: str, measure: str) -> str:
    ranked = _RANKED.replace("ID AS", f"{id_column} AS").replace("SCORE AS", f"{score} AS").replace("ORDERED", order).replace("SOURCE", table)
    return f"""{with_tables(table, recursive=True)},
{ranked},
s AS (
  SELECT image_id, k, [{_ITEM}] AS kept FROM r WHERE k = 1
  UNION ALL
  SELECT r.image_id, r.k, CASE WHEN len(list_filter(s.kept, lambda y: {measure})) = 0 THEN list_append(s.kept, {_ITEM}) ELSE s.kept END
  FROM s JOIN r ON r.image_id = s.image_id AND r.k = s.k + 1),
l AS (SELECT image_id, arg_max(kept, k) AS kept FROM s GROUP BY image_id)
SELECT image_id, unnest(kept).id AS {id_column} FROM l"""


R.add("nms", "fx_det", lambda d: suppression.nms(d, 0.5).select("image_id", "det_id"), _nms_sql("fx_det", "det_id", "score", "score DESC, det_id", f"{_iou('y.', 'r.')} > 0.5e0"))
R.add("nms_crowded", "fx_det", lambda d: suppression.nms(d, 0.5, crowded=6).select("image_id", "det_id"), R.oracle["nms"])
R.add("nms_equal_scores", "fx_gt", lambda g: suppression.first_box_wins(g, 0.4).select("image_id", "annotation_id"), _nms_sql("fx_gt", "annotation_id", "0", "annotation_id", f"{_iou('y.', 'r.')} > 0.4e0"))
R.add("lsnms", "fx_det", lambda d: suppression.lsnms(d, 0.5).select("image_id", "det_id"), R.oracle["nms"])
R.add("nms_ios", "fx_det", lambda d: suppression.nms(d, 0.5, measure="ios").select("image_id", "det_id"), _nms_sql("fx_det", "det_id", "score", "score DESC, det_id", f"{_ios('y.', 'r.')} > 0.5e0"))
_MERGE = "list_transform(s.kept, lambda y, i: CASE WHEN i = POS THEN {'id': y.id, 'score': y.score, 'x_min': least(y.x_min, r.x_min), 'y_min': least(y.y_min, r.y_min), 'x_max': greatest(y.x_max, r.x_max), 'y_max': greatest(y.y_max, r.y_max)} ELSE y END)"
_POS = f"list_position(list_transform(s.kept, lambda y: {_ios('y.', 'r.')} > 0.5e0), true)"
R.add(
    "nmm",
    "fx_det",
    lambda d: suppression.merged(d, 0.5),
    f"""{with_tables("fx_det", recursive=True)},
{_RANKED.replace("ID AS", "det_id AS").replace("SCORE AS", "score AS").replace("ORDERED", "score DESC, det_id").replace("SOURCE", "fx_det")},
s AS (
  SELECT image_id, k, [{_ITEM}] AS kept FROM r WHERE k = 1
  UNION ALL
  SELECT r.image_id, r.k, CASE WHEN coalesce({_POS}, 0) = 0 THEN list_append(s.kept, {_ITEM}) ELSE {_MERGE.replace("POS", _POS)} END
  FROM s JOIN r ON r.image_id = s.image_id AND r.k = s.k + 1),
l AS (SELECT image_id, unnest(arg_max(kept, k)) AS b FROM s GROUP BY image_id)
SELECT image_id, b.id AS det_id, round(b.score, 6) AS score, b.x_min AS x_min, b.y_min AS y_min, b.x_max AS x_max, b.y_max AS y_max FROM l""",
)


def _tiled(d):
    """Detections as seen in tiles of 640, the tile's corner beside them."""
    x0, y0 = (F.floor(F.col("x_min") / 640) * 640).cast("int"), (F.floor(F.col("y_min") / 640) * 640).cast("int")
    moved = d.withColumns({"x0": x0, "y0": y0})
    return moved.withColumns({"x_min": F.col("x_min") - F.col("x0"), "x_max": F.col("x_max") - F.col("x0"), "y_min": F.col("y_min") - F.col("y0"), "y_max": F.col("y_max") - F.col("y0")})


R.add("merge_tile_detections", "fx_det", lambda d: suppression.merge_tile_detections(_tiled(d), "nms", 0.5, "iou").select("image_id", "det_id", "x_min", "y_min"), f"SELECT n.image_id, n.det_id, d.x_min, d.y_min FROM ({R.oracle['nms']}) n JOIN ({with_tables('fx_det')} SELECT * FROM fx_det) d ON d.det_id = n.det_id")

# average precision: the taken ground truth is carried along the ranks of an image's class
_AP = f"""{with_tables("fx_gt", "fx_det", recursive=True)},
t AS (SELECT unnest([TS]) AS threshold),
cl AS (SELECT det_id, image_id, category_id, greatest(x_min, 0) AS x_min, greatest(y_min, 0) AS y_min, greatest(x_max, 0) AS x_max, greatest(y_max, 0) AS y_max FROM fx_det),
near AS MATERIALIZED (SELECT d.det_id, g.annotation_id, {_iou(DET, GT)} AS iou FROM cl d JOIN fx_gt g ON d.image_id = g.image_id AND d.category_id = g.category_id),
o AS MATERIALIZED (SELECT det_id, list({{'iou': iou, 'id': annotation_id}} ORDER BY iou DESC, annotation_id) AS opts FROM near WHERE iou >= 0.4e0 GROUP BY det_id),
r AS MATERIALIZED (SELECT d.image_id, d.file_name, d.category_id, d.det_id, d.score, threshold, coalesce(opts, []) AS opts,
    row_number() OVER (PARTITION BY d.image_id, d.category_id, threshold ORDER BY d.score DESC, d.det_id) AS k FROM fx_det d CROSS JOIN t LEFT JOIN o USING (det_id)),
s AS (
  SELECT image_id, file_name, category_id, threshold, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS hit, CAST(0 AS DOUBLE) AS score FROM r WHERE k = 1
  UNION ALL
  SELECT z.image_id, z.file_name, z.category_id, z.threshold, z.k, CASE WHEN z.pick IS NULL THEN z.taken ELSE list_append(z.taken, z.pick) END, CAST(z.pick IS NOT NULL AS BIGINT), z.score FROM (
    SELECT r.image_id, r.file_name, r.category_id, r.threshold, r.k, s.taken, r.score,
      (list_filter(r.opts, lambda y: y.iou >= r.threshold AND NOT list_contains(s.taken, y.id)))[1].id AS pick
    FROM s JOIN r ON r.image_id = s.image_id AND r.category_id = s.category_id AND r.threshold = s.threshold AND r.k = s.k + 1) z),
hits AS MATERIALIZED (SELECT * FROM s WHERE k > 0)"""
_IMAGE_AP = _AP.replace("TS", "0.5e0, 0.75e0") + """,
pos AS (SELECT image_id, category_id, count(*) AS positives FROM fx_gt GROUP BY ALL),
u AS (SELECT h.*, positives, sum(hit) OVER (PARTITION BY image_id, category_id, threshold ORDER BY k) AS tp FROM hits h JOIN pos USING (image_id, category_id)),
x AS (SELECT *, max(CAST(tp AS DOUBLE) / k) OVER (PARTITION BY image_id, category_id, threshold ORDER BY k DESC) AS best,
    floor(100e0 * tp / positives) - coalesce(lag(floor(100e0 * tp / positives)) OVER (PARTITION BY image_id, category_id, threshold ORDER BY k), -1) AS points FROM u),
ap AS (SELECT image_id, category_id, threshold, sum(best * points) / 101 AS ap FROM x GROUP BY ALL),
every AS (SELECT pos.image_id, pos.category_id, threshold, coalesce(ap, 0) AS ap FROM pos CROSS JOIN t LEFT JOIN ap USING (image_id, category_id, threshold)),
imap AS MATERIALIZED (SELECT d.image_id, d.file_name, coalesce(avg(ap) FILTER (WHERE threshold = 0.5e0), -1) AS map50, coalesce(avg(ap) FILTER (WHERE threshold = 0.75e0), -1) AS map75
  FROM (SELECT DISTINCT image_id, file_name FROM fx_det) d LEFT JOIN every USING (image_id) GROUP BY ALL)"""
R.add("image_ap", "fx_det fx_gt", lambda d, g: metrics.image_ap(d, g).drop("image_id"), f"{_IMAGE_AP}\nSELECT file_name, round(map50, 6) AS map50, round(map75, 6) AS map75 FROM imap")
_LEVELS = """,
pos AS (SELECT category_id, count(*) AS positives FROM fx_gt GROUP BY ALL),
lv AS (SELECT category_id, threshold, score, sum(hit) AS h, count(*) AS n FROM hits GROUP BY ALL),
cu AS (SELECT category_id, threshold, score, positives, CAST(sum(h) OVER w AS DOUBLE) AS tp, sum(n) OVER w AS n FROM lv JOIN pos USING (category_id) WINDOW w AS (PARTITION BY category_id, threshold ORDER BY score DESC))"""
R.add(
    "dataset_ap",
    "fx_det fx_gt",
    metrics.dataset_ap,
    _AP.replace("TS", "0.5e0, 0.6e0")
    + _LEVELS
    + """,
x AS (SELECT *, max(tp / n) OVER (PARTITION BY category_id, threshold ORDER BY score) AS best,
    floor(100e0 * tp / positives) - coalesce(lag(floor(100e0 * tp / positives)) OVER (PARTITION BY category_id, threshold ORDER BY score DESC), -1) AS points FROM cu)
SELECT category_id, threshold, round(sum(best * points) / 101, 6) AS ap FROM x GROUP BY ALL""",
)
R.add("pr_curve", "fx_det fx_gt", metrics.pr_curve, _AP.replace("TS", "0.5e0") + _LEVELS + "\nSELECT category_id, round(score, 6) AS score, round(tp / n, 6) AS precision, round(tp / positives, 6) AS recall FROM cu")
# images that hold hundreds of boxes of a class: all of them, and the 100 of highest score
_CROWD = re.sub(r"\bfx_(gt|det)\b", r"fx_crowd_\1", _AP.split(",\nt AS (", 1)[1])
_CROWD = f"""{with_tables("fx_crowd_gt", "fx_crowd_det", recursive=True)},
t AS ({_CROWD}"""
_CROWD_LEVELS = _LEVELS.replace("fx_gt", "fx_crowd_gt")
R.add("pr_curve_crowded", "fx_crowd_det fx_crowd_gt", lambda d, g: metrics.pr_curve(d, g, crowded=64), _CROWD.replace("TS", "0.5e0") + _CROWD_LEVELS + "\nSELECT category_id, round(score, 6) AS score, round(tp / n, 6) AS precision, round(tp / positives, 6) AS recall FROM cu")
R.add("greedy_hits_crowded", "fx_crowd_det fx_crowd_gt", lambda d, g: metrics.greedy_hits(d, g, (0.4, 0.7), crowded=0).groupBy("image_id", "category_id", "threshold").agg(F.sum("hit").cast("bigint").alias("hits"), F.count(F.lit(1)).alias("n")), _CROWD.replace("TS", "0.4e0, 0.7e0") + "\nSELECT image_id, category_id, threshold, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n FROM hits GROUP BY ALL")
_MOST = "QUALIFY row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) <= 100"
R.add(
    "dataset_ap_crowded",
    "fx_crowd_det fx_crowd_gt",
    lambda d, g: metrics.dataset_ap(d, g, max_detections=100, crowded=64),
    _CROWD.replace("TS", "0.5e0, 0.6e0").replace("FROM fx_crowd_det d CROSS JOIN", f"FROM (SELECT * FROM fx_crowd_det {_MOST}) d CROSS JOIN") + _CROWD_LEVELS + R.oracle["dataset_ap"].split(_LEVELS, 1)[1],
)
_POINTS = f"""{with_tables("fx_gt", "fx_det", recursive=True)},
p AS MATERIALIZED (SELECT * FROM (SELECT d.image_id, d.category_id, d.det_id, g.annotation_id, sqrt(power((d.x_min + d.x_max - g.x_min - g.x_max) / 2e0, 2) + power((d.y_min + d.y_max - g.y_min - g.y_max) / 2e0, 2)) AS v
  FROM fx_det d JOIN fx_gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) WHERE v <= 20),
near AS MATERIALIZED (SELECT DISTINCT a.det_id AS a, b.det_id AS b FROM p a JOIN p b USING (annotation_id)),
walk AS (SELECT a, b FROM near UNION SELECT walk.a, near.b FROM walk JOIN near ON near.a = walk.b),
part AS MATERIALIZED (SELECT a AS det_id, min(b) AS part FROM walk GROUP BY a),
o AS MATERIALIZED (SELECT part, det_id, list({{'id': annotation_id, 'v': v}}) AS opts, any_value(category_id) AS category_id, row_number() OVER (PARTITION BY part ORDER BY det_id) AS k FROM p JOIN part USING (det_id) GROUP BY part, det_id),
w AS (
  SELECT part, category_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(0 AS DOUBLE) AS total FROM o WHERE k = 1
  UNION ALL
  SELECT w.part, w.category_id, o.k, CASE WHEN z.x.id IS NULL THEN w.taken ELSE list_append(w.taken, z.x.id) END, w.total + coalesce(z.x.v, 0)
  FROM w JOIN o ON o.part = w.part AND o.k = w.k + 1, LATERAL (SELECT unnest(list_append(list_filter(o.opts, lambda y: NOT list_contains(w.taken, y.id)), NULL)) AS x) z),
last AS (SELECT part, max(k) AS k FROM o GROUP BY part),
best AS (SELECT part, w.category_id, len(taken) AS n, total FROM w JOIN last USING (part, k) QUALIFY row_number() OVER (PARTITION BY part ORDER BY len(taken) DESC, total) = 1)"""
R.add("point_matches", "fx_det fx_gt", lambda d, g: metrics.point_matches(d, g).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt("value")).alias("total")), f"{_POINTS}\nSELECT category_id, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total FROM best GROUP BY ALL", places=4)
R.add(
    "point_metrics",
    "fx_det fx_gt",
    metrics.point_metrics,
    f"""{_POINTS},
tp AS (SELECT category_id, CAST(sum(n) AS BIGINT) AS tp FROM best GROUP BY ALL),
n AS (SELECT image_id, category_id, sum(d) AS d, sum(g) AS g FROM (SELECT image_id, category_id, 1 AS d, 0 AS g FROM fx_det UNION ALL SELECT image_id, category_id, 0, 1 FROM fx_gt) GROUP BY ALL),
a AS (SELECT category_id, CAST(sum(d) AS BIGINT) AS dets, CAST(sum(g) AS BIGINT) AS gts, avg(abs(d - g)) AS mae, avg((d - g) * (d - g)) AS mse FROM n GROUP BY ALL),
q AS (SELECT a.*, coalesce(tp, 0) AS tp, coalesce(tp, 0) / (dets + 1e-8) AS p, coalesce(tp, 0) / (gts + 1e-8) AS r FROM a LEFT JOIN tp USING (category_id))
SELECT category_id, tp, dets - tp AS fp, gts - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1, round(mae, 6) AS mae, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse FROM q""",
)
R.add(
    "parameter_sweep",
    "fx_det fx_gt",
    metrics.parameter_sweep,
    f"""{with_tables("fx_gt", "fx_det")},
p AS (SELECT d.det_id, g.annotation_id, {_iou(DET, GT)} AS iou FROM fx_det d JOIN fx_gt g ON d.image_id = g.image_id),
b AS (SELECT det_id, max(iou) AS iou, arg_min(annotation_id, (-iou, annotation_id)) AS annotation_id FROM p GROUP BY det_id),
x AS (SELECT s.s AS min_score, t.t AS min_iou, d.det_id, CASE WHEN coalesce(b.iou, 0) >= t.t THEN annotation_id END AS annotation_id
  FROM fx_det d LEFT JOIN b USING (det_id) CROSS JOIN (SELECT unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0]) AS s) s CROSS JOIN (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS t) t WHERE d.score >= s.s),
c AS (SELECT min_score, min_iou, count(DISTINCT annotation_id) AS tp, count(*) AS dets FROM x GROUP BY ALL),
f AS (SELECT min_score, min_iou, tp, dets - tp AS fp, (SELECT count(*) FROM fx_gt) - tp AS fn, 2e0 * tp / (dets + (SELECT count(*) FROM fx_gt)) AS f1 FROM c)
SELECT min_score, min_iou, tp, fp, fn, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, min_score, min_iou) = 1 AS is_best FROM f""",
)
_TABLE = (
    _IMAGE_AP
    + ",\n"
    + CIOU.split("FROM fx_base WHERE rn % 6 = 1 AND image_id % 11 <> 3),", 1)[1].lstrip()
    + """,
profile AS (SELECT image_id, max(score) AS max_score FROM fx_det GROUP BY ALL),
tab AS MATERIALIZED (SELECT coalesce(ratios.file_name, q.file_name) AS file_name, map50, map75, max_score, uncertainty, fn_tp_ratio, fp_tp_ratio
  FROM ratios FULL JOIN (SELECT * FROM imap LEFT JOIN profile USING (image_id) LEFT JOIN entropy USING (image_id, file_name)) q ON ratios.image_id = q.image_id),
er AS (SELECT file_name FROM tab WHERE fp_tp_ratio > 0.2e0 OR fn_tp_ratio > 0.2e0),
qu AS (SELECT file_name FROM tab WHERE (map50 < 0.3e0 AND map75 < 0.3e0 AND (max_score > 0.7e0 OR max_score < 1 - 0.7e0)) OR uncertainty > 4e0)"""
)
_COLS = "file_name, round(map50, 6) AS map50, round(map75, 6) AS map75, round(uncertainty, 6) AS uncertainty, round(fn_tp_ratio, 6) AS fn_tp_ratio, round(fp_tp_ratio, 6) AS fp_tp_ratio"
R.add("hard_by_quality", "fx_det fx_gt", lambda d, g: selection.hard_by_quality(selection.image_table(d, g)).select("file_name", "map50", "map75", "uncertainty", "fn_tp_ratio", "fp_tp_ratio"), f"{_TABLE}\nSELECT {_COLS} FROM tab WHERE file_name IN (SELECT file_name FROM qu)")
R.add("hard_samples", "fx_det fx_gt", lambda d, g: selection.hard_samples(selection.image_table(d, g)).drop("all_scores"), f"{_TABLE}\nSELECT {_COLS}, CASE WHEN file_name IN (SELECT file_name FROM er) THEN 'errors' ELSE 'quality' END AS by FROM tab WHERE file_name IN (SELECT file_name FROM er UNION SELECT file_name FROM qu)")
R.add("image_metrics", "fx_det fx_gt", lambda d, g: selection.failed(selection.image_table(d, g)).select("file_name", "tp", "fp", "fn", "map50", "map75", "failed"), f"{_TABLE}\nSELECT coalesce(c.file_name, i.file_name) AS file_name, tp, fp, fn, round(map50, 6) AS map50, round(map75, 6) AS map75, map75 < 0.3e0 AS failed FROM counts c FULL JOIN imap i ON c.image_id = i.image_id")
R.add("mean_objective", "fx_det fx_gt", lambda d, g: stats.mean_objective(metrics.image_ap(d, g)), f"{_IMAGE_AP}\nSELECT round(avg(map50), 6) AS map50, round(avg(map75), 6) AS map75, round(-avg(map50) - avg(map75), 6) AS objective FROM imap WHERE map50 >= 0")
R.add(
    "metric_correlations",
    "fx_det fx_gt",
    lambda d, g: stats.metric_correlations(selection.image_table(d, g), ["map50", "uncertainty", "max_score"]),
    f"{_TABLE},\nm AS (SELECT corr(map50, uncertainty) AS a, corr(map50, max_score) AS b, corr(uncertainty, max_score) AS c FROM tab)\n"
    + "\nUNION ALL ".join(f"SELECT '{x}' AS first, '{y}' AS second, round({v}, 6) AS corr FROM m" for x, y, v in (("map50", "map50", "1e0"), ("map50", "uncertainty", "a"), ("map50", "max_score", "b"), ("uncertainty", "uncertainty", "1e0"), ("uncertainty", "max_score", "c"), ("max_score", "max_score", "1e0"))),
)
QUERIES, ORACLE = R.queries, R.oracle
