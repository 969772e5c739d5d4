"""Queries on rotated boxes. The SQL clips polygons edge by edge, as lists of points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from boxlake.functions import boxes
from boxlake.operators import conversions, suppression
from boxlake.plans.fixtures import with_tables
from boxlake.plans.registry import Registry

R = Registry()


def _turned(table):
    """Upright boxes of a fixture table as rotated ones: each turned about its centre by its id's twelfths of pi."""
    key = "det_id" if "det_id" in table.columns else "annotation_id"
    double = lambda c: F.col(c).cast("double")
    return table.select("*", ((double("x_min") + double("x_max")) / 2).alias("cx"), ((double("y_min") + double("y_max")) / 2).alias("cy"), (double("x_max") - double("x_min")).alias("w"), (double("y_max") - double("y_min")).alias("h"), ((F.col(key) % 11 - 5) * F.lit(math.pi / 12)).alias("angle"))


def _corners_sql(key: str, table: str) -> str:
    point = lambda i, j: f"{{'x': cx + {i} * w / 2 * c - {j} * h / 2 * s, 'y': cy + {i} * w / 2 * s + {j} * h / 2 * c}}"
    return f"""(SELECT *, [{point(-1, -1)}, {point(1, -1)}, {point(1, 1)}, {point(-1, 1)}] AS p FROM (
    SELECT *, cos(angle) AS c, sin(angle) AS s FROM (
      SELECT *, (CAST(x_min AS DOUBLE) + x_max) / 2 AS cx, (CAST(y_min AS DOUBLE) + y_max) / 2 AS cy, CAST(x_max - x_min AS DOUBLE) AS w, CAST(y_max - y_min AS DOUBLE) AS h,
        ({key} % 11 - 5) * {math.pi / 12!r}e0 AS angle FROM {table})))"""


def _area_sql(poly: str) -> str:
    return f"abs(list_sum([{poly}[i].x * {poly}[i % len({poly}) + 1].y - {poly}[i % len({poly}) + 1].x * {poly}[i].y FOR i IN range(1, len({poly}) + 1)])) / 2"


#: What is left of polygon a (a list of points) after the edge e[1] to e[2] has cut off what lies on its outer side.
_SIDE = "((e[2].x - e[1].x) * ({p}.y - e[1].y) - (e[2].y - e[1].y) * ({p}.x - e[1].x))"
_P, _Q = "a[i]", "a[i % len(a) + 1]"
_SP, _SQ = _SIDE.format(p=_P), _SIDE.format(p=_Q)
_CROSS = f"{{'x': {_P}.x + {_SP} / ({_SP} - {_SQ}) * ({_Q}.x - {_P}.x), 'y': {_P}.y + {_SP} / ({_SP} - {_SQ}) * ({_Q}.y - {_P}.y)}}"
_CUT = f"flatten([CASE WHEN ({_SP} >= 0) <> ({_SQ} >= 0) THEN CASE WHEN {_SP} >= 0 THEN [{_P}, {_CROSS}] ELSE [{_CROSS}] END WHEN {_SP} >= 0 THEN [{_P}] ELSE [] END FOR i IN range(1, len(a) + 1)])"


def _shared_sql(a: str, b: str) -> str:
    """The polygon that two of them share."""
    return f"list_reduce([{a}, {b}[1:2], {b}[2:3], {b}[3:4], [{b}[4], {b}[1]]], lambda a, e: {_CUT})"


_HULL = "list_min([z.x FOR z IN {0}.p]) AS {0}_x0, list_max([z.x FOR z IN {0}.p]) AS {0}_x1, list_min([z.y FOR z IN {0}.p]) AS {0}_y0, list_max([z.y FOR z IN {0}.p]) AS {0}_y1"
_NEAR = "d_x0 < g_x1 AND g_x0 < d_x1 AND d_y0 < g_y1 AND g_y0 < d_y1"
R.add(
    "rotated_iou",
    "fx_det fx_gt",
    lambda d, g: suppression.rotated_pairs(_turned(d), _turned(g)).select("det_id", "annotation_id", (F.col("value") + 1e-9).alias("value")),  # quotients half way between two roundings
    f"""{with_tables("fx_gt", "fx_det")},
d AS {_corners_sql("det_id", "fx_det")},
g AS {_corners_sql("annotation_id", "fx_gt")},
n AS (SELECT * FROM (SELECT d.det_id, g.annotation_id, d.p AS dp, g.p AS gp, d.w * d.h + g.w * g.h AS areas, {_HULL.format("d")}, {_HULL.format("g")} FROM d JOIN g ON d.image_id = g.image_id) WHERE {_NEAR}),
s AS (SELECT det_id, annotation_id, areas, {_shared_sql("dp", "gp")} AS q FROM n),
v AS (SELECT det_id, annotation_id, areas, CASE WHEN len(q) >= 3 THEN {_area_sql("q")} ELSE 0 END AS shared FROM s)
SELECT det_id, annotation_id, round(shared / (areas - shared) + 1e-9, 5) + 0e0 AS value FROM v""",
    places=5,
)
# suppression: overlaps over the threshold are found first, then the list of kept boxes is carried along the ranks
_NMS = f"""{with_tables("fx_det", recursive=True)},
d AS MATERIALIZED {_corners_sql("det_id", "fx_det")},
n AS (SELECT * FROM (SELECT d.det_id, g.det_id AS other, d.p AS dp, g.p AS gp, d.w * d.h + g.w * g.h AS areas, {_HULL.format("d")}, {_HULL.format("g")} FROM d JOIN d g ON d.image_id = g.image_id AND d.det_id < g.det_id) WHERE {_NEAR}),
s AS (SELECT det_id, other, areas, {_shared_sql("dp", "gp")} AS q FROM n),
v AS (SELECT det_id, other, areas, CASE WHEN len(q) >= 3 THEN {_area_sql("q")} ELSE 0 END AS shared FROM s),
c AS (SELECT det_id, other FROM v WHERE shared / (areas - shared) > 0.4e0),
o AS (SELECT det_id, list(other) AS clash FROM (SELECT det_id, other FROM c UNION ALL SELECT other, det_id FROM c) GROUP BY det_id),
r AS MATERIALIZED (SELECT image_id, d.det_id, coalesce(clash, []) AS clash, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, d.det_id) AS k FROM d LEFT JOIN o USING (det_id)),
w AS (
  SELECT image_id, k, [det_id] AS kept FROM r WHERE k = 1
  UNION ALL
  SELECT r.image_id, r.k, CASE WHEN list_has_any(w.kept, r.clash) THEN w.kept ELSE list_append(w.kept, r.det_id) END FROM w JOIN r ON r.image_id = w.image_id AND r.k = w.k + 1)
SELECT image_id, unnest(arg_max(kept, k)) AS det_id FROM w GROUP BY image_id"""
_USED = ("image_id", "det_id", "score", "cx", "cy", "w", "h", "angle")  # rows pass through whole
R.add("rotated_nms", "fx_det", lambda d: suppression.rotated_nms(_turned(d).select(*_USED), 0.4).select("image_id", "det_id"), _NMS)
R.add("rotated_nms_cells", "fx_det", lambda d: suppression.rotated_nms(_turned(d).select(*_USED), 0.4, cell=256).select("image_id", "det_id"), _NMS)


def _as_polygons(d):
    corners = boxes.rotated_corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")))
    return d.select("det_id", corners.alias("points"))


R.add(
    "oriented_boxes_of_turned_polygons",
    "fx_det",
    lambda d: conversions.polygon_to_oriented_box(_as_polygons(_turned(d))).select("det_id", "cx", "cy", "w", "h", "angle"),
    f"{with_tables('fx_det')},\nd AS {_corners_sql('det_id', 'fx_det')}\nSELECT det_id, round(cx, 4) + 0e0 AS cx, round(cy, 4) + 0e0 AS cy, round(w, 4) + 0e0 AS w, round(h, 4) + 0e0 AS h, round(angle, 4) + 0e0 AS angle FROM d",
    places=4,
)
QUERIES, ORACLE = R.queries, R.oracle
