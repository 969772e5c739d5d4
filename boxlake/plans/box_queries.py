"""Queries on conversions, labels, tiles, samples, statistics, names and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlake.functions import geo, paths
from boxlake.operators import checks, labels, sampling, stats, tiling
from boxlake.operators import conversions as cv
from boxlake.plans.fixtures import with_tables
from boxlake.plans.registry import Registry

R = Registry()
NAMES = {0: "buffalo", 1: "impala", 2: "nyala", 3: "nyala(m)", 4: "roan", 5: "sable"}
_CORNERS = "x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y - h / 2 AS y2, x + w / 2 AS x3, y + h / 2 AS y3, x - w / 2 AS x4, y + h / 2 AS y4"
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in cv.CORNERS)
_OBB = f"{with_tables('fx_yolo')},\no AS (SELECT annotation_id, image_id, file_name, category_id, {_CORNERS} FROM fx_yolo)"


def _int(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


# conversions
R.add("yolo_to_obb", "fx_yolo", cv.yolo_to_obb, f"{_OBB}\nSELECT annotation_id, image_id, file_name, category_id, {_ROUND} FROM o")
R.add(
    "obb_to_yolo",
    "fx_yolo",
    lambda y: cv.obb_to_yolo(cv.yolo_to_obb(y)),
    f"{_OBB}\nSELECT annotation_id, image_id, file_name, category_id, round((x1 + x2) / 2, 6) AS x, round((y1 + y4) / 2, 6) AS y, round(x2 - x1, 6) AS w, round(y4 - y1, 6) AS h FROM o",
)
R.add(
    "obb_to_dota",
    "fx_yolo fx_images fx_label_map",
    lambda y, i, m: cv.obb_to_dota(cv.yolo_to_obb(y), i, m).select("annotation_id", *cv.CORNERS, "label_name", "difficulty"),
    f"{with_tables('fx_yolo', 'fx_images', 'fx_label_map')},\no AS (SELECT annotation_id, image_id, category_id, {_CORNERS} FROM fx_yolo)\nSELECT annotation_id, {', '.join(_int(f'{c} * {"width" if c[0] == "x" else "height"}') + f' AS {c}' for c in cv.CORNERS)}, category_name AS label_name, CAST(0 AS INT) AS difficulty FROM o JOIN fx_images USING (image_id) JOIN fx_label_map USING (category_id)",
)
_COCO = f"""{with_tables('fx_yolo', 'fx_images')},
e AS (SELECT y.annotation_id, y.image_id, y.file_name, y.category_id, {_int('(x - w / 2) * width')} AS a, {_int('(y - h / 2) * height')} AS b, {_int('(x + w / 2) * width')} AS c, {_int('(y + h / 2) * height')} AS d FROM fx_yolo y JOIN fx_images i USING (image_id))"""
R.add(
    "yolo_to_coco",
    "fx_yolo fx_images",
    lambda y, i: cv.yolo_to_coco(y, i).drop("segmentation", "file_name"),
    f"{_COCO}\nSELECT annotation_id, image_id, category_id, a AS bbox_x, b AS bbox_y, c - a AS bbox_w, d - b AS bbox_h, (c - a) * (d - b) AS area, CAST(0 AS INT) AS iscrowd FROM e",
)
R.add("coco_ids", "fx_yolo", lambda y: cv.sequential_ids(y.select("file_name", "annotation_id"), "file_name", ["annotation_id"]), f"{with_tables('fx_yolo')}\nSELECT file_name, annotation_id, row_number() OVER (ORDER BY file_name, annotation_id) - 1 AS id FROM fx_yolo")
R.add(
    "denormalise_boxes",
    "fx_yolo fx_images",
    lambda y, i: cv.denormalise_boxes(y, i).select("annotation_id", *cv.CORNERS, "x_min", "y_min", "x_max", "y_max"),
    f"{with_tables('fx_yolo', 'fx_images')},\no AS (SELECT annotation_id, image_id, {_CORNERS} FROM fx_yolo),\np AS (SELECT annotation_id, {', '.join(f'{c} * {"width" if c[0] == "x" else "height"} AS {c}' for c in cv.CORNERS)} FROM o JOIN fx_images USING (image_id))\nSELECT annotation_id, {_ROUND}, round(x1, 6) AS x_min, round(y1, 6) AS y_min, round(x2, 6) AS x_max, round(y3, 6) AS y_max FROM p",
)
R.add("point_annotations", "fx_yolo fx_images", cv.to_point_annotations, f"{with_tables('fx_yolo', 'fx_images')}\nSELECT annotation_id, y.file_name AS images, category_id + 1 AS labels, round(x * width, 6) AS x, round(y.y * height, 6) AS y, round(w * width, 6) AS w, round(h * height, 6) AS h FROM fx_yolo y JOIN fx_images i USING (image_id)")
R.add("blank_points", "fx_images fx_gt", lambda i, g: cv.blank_points(labels.empty(i, g)), f"{with_tables('fx_images', 'fx_gt')}\nSELECT file_name AS images, 0e0 AS x, 0e0 AS y, CAST(0 AS INT) AS labels FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_gt)")
R.add("aabb", "fx_yolo", lambda y: cv.corners_to_aabb(cv.yolo_to_obb(y)).select("annotation_id", "x_min", "y_min", "x_max", "y_max"), f"{_OBB}\nSELECT annotation_id, round(least(x1, x2, x3, x4), 6) AS x_min, round(least(y1, y2, y3, y4), 6) AS y_min, round(greatest(x1, x2, x3, x4), 6) AS x_max, round(greatest(y1, y2, y3, y4), 6) AS y_max FROM o")
#: Each edge moves by half of the box's size (factor 2); the far ones by half of what lies between them and the near ones as moved.
_EXPAND = """x1 AS (SELECT *, greatest(x_min - 0.5e0 * (x_max - x_min), 0e0) AS x1, greatest(y_min - 0.5e0 * (y_max - y_min), 0e0) AS y1 FROM SRC)"""
R.add("expand_boxes", "fx_gt", lambda g: cv.expand_box(g, 2.0).select("annotation_id", "x1", "y1", "x2", "y2"), f"{with_tables('fx_gt')},\n{_EXPAND.replace('SRC', 'fx_gt')}\nSELECT annotation_id, {_int('x1')} AS x1, {_int('y1')} AS y1, {_int('least(x_max + 0.5e0 * (x_max - x1), width)')} AS x2, {_int('least(y_max + 0.5e0 * (y_max - y1), height)')} AS y2 FROM x1")
_PCT = "100e0 * x_min / width AS px, 100e0 * y_min / height AS py, 100e0 * (x_max - x_min) / width AS pw, 100e0 * (y_max - y_min) / height AS ph"
R.add("percent_results", "fx_gt", lambda g: cv.percent_columns(g).select("annotation_id", "px", "py", "pw", "ph"), f"{with_tables('fx_gt')},\np AS (SELECT annotation_id, {_PCT} FROM fx_gt)\nSELECT annotation_id, round(px, 6) AS px, round(py, 6) AS py, round(pw, 6) AS pw, round(ph, 6) AS ph FROM p")
R.add("percent_to_boxes", "fx_gt", lambda g: cv.percent_result_to_box(cv.percent_columns(g).drop("x_min", "y_min", "x_max", "y_max")).select("annotation_id", "x_min", "y_min", "x_max", "y_max"), f"{with_tables('fx_gt')}\nSELECT annotation_id, round(CAST(x_min AS DOUBLE), 6) AS x_min, round(CAST(y_min AS DOUBLE), 6) AS y_min, round(CAST(x_max AS DOUBLE), 6) AS x_max, round(CAST(y_max AS DOUBLE), 6) AS y_max FROM fx_gt")


def _polygons(p):
    point = F.struct("vertex_no", F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("p"))
    return p.groupBy("polygon_id", "image_id", "width", "height").agg(F.transform(F.sort_array(F.collect_list(point)), lambda v: v["p"]).alias("points"))


_BOUNDS = f"{with_tables('fx_polygons')},\nb AS (SELECT polygon_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM fx_polygons GROUP BY polygon_id),\ne AS (SELECT *, greatest({_int('x0')}, 0) AS x_min, greatest({_int('y0')}, 0) AS y_min, greatest({_int('x1')}, 0) AS x_max, greatest({_int('y1')}, 0) AS y_max FROM b)"
R.add("polygon_bbox", "fx_polygons", lambda p: cv.polygon_to_bbox(_polygons(p)).drop("points", "image_id", "width", "height"), f"{_BOUNDS}\nSELECT polygon_id, x_min, y_min, x_max, y_max, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y, x_max - x_min AS bbox_w, y_max - y_min AS bbox_h FROM e")
R.add("polygon_percent", "fx_polygons", lambda p: cv.polygon_to_percent(_polygons(p)).select("polygon_id", F.posexplode("points").alias("vertex_no", "p")).select("polygon_id", "vertex_no", F.col("p.x").alias("px"), F.col("p.y").alias("py")), f"{with_tables('fx_polygons')}\nSELECT polygon_id, vertex_no, round(100e0 * px / width, 6) AS px, round(100e0 * py / height, 6) AS py FROM fx_polygons")
R.add("polygon_seg_rows", "fx_polygons", lambda p: cv.polygon_to_seg_row(_polygons(p).withColumn("pixel_value", (F.col("polygon_id") % 7).cast("int"))).select("polygon_id", F.split("value", " ")[0].cast("int").alias("class"), (F.size(F.split("value", " ")) - 1).alias("n_numbers")), f"{with_tables('fx_polygons')}\nSELECT polygon_id, CAST(polygon_id % 7 - 1 AS INT) AS class, CAST(2 * count(*) AS INT) AS n_numbers FROM fx_polygons WHERE polygon_id % 7 >= 1 GROUP BY polygon_id")
R.add("polygon_oriented_boxes", "fx_polygons", lambda p: cv.polygon_to_oriented_box(_polygons(p)).select("polygon_id", "cx", "cy", "w", "h", "angle"), f"{with_tables('fx_polygons')}\nSELECT polygon_id, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy, round(max(px) - min(px), 6) AS w, round(max(py) - min(py), 6) AS h, 0e0 AS angle FROM fx_polygons GROUP BY polygon_id")
R.add("normalise_by_image", "fx_gt", lambda g: cv.normalise_by_image(g, "shift").select("annotation_id", "category_id", "x", "y", "w", "h"), f"{with_tables('fx_gt')}\nSELECT annotation_id, category_id - (SELECT min(category_id) FROM fx_gt) AS category_id, round((x_min + x_max) / 2e0 / width, 6) AS x, round((y_min + y_max) / 2e0 / height, 6) AS y, round((x_max - x_min) / CAST(width AS DOUBLE), 6) AS w, round((y_max - y_min) / CAST(height AS DOUBLE), 6) AS h FROM fx_gt")
R.add("relative_boxes", "fx_det", lambda d: cv.relative_boxes(d).select("det_id", "x", "y", "w", "h"), f"{with_tables('fx_det')}\nSELECT det_id, round(CAST(x_min AS DOUBLE) / width, 6) AS x, round(CAST(y_min AS DOUBLE) / height, 6) AS y, round(CAST(x_max - x_min AS DOUBLE) / width, 6) AS w, round(CAST(y_max - y_min AS DOUBLE) / height, 6) AS h FROM fx_det")
R.add("coco_results", "fx_det", lambda d: cv.int_bbox(cv.xyxy_to_coco_result(d)).select("image_id", "category_id", *(F.col("bbox")[k].alias(c) for k, c in enumerate(("bx", "by", "bw", "bh"))), "score"), f"{with_tables('fx_det')}\nSELECT image_id, category_id, x_min AS bx, y_min AS by, x_max - x_min AS bw, y_max - y_min AS bh, round(score, 6) AS score FROM fx_det")


def _nested(d):
    box = F.struct(F.array(*(F.col(c).cast("double") for c in ("x_min", "y_min")), (F.col("x_max") - F.col("x_min")).cast("double"), (F.col("y_max") - F.col("y_min")).cast("double")).alias("bbox"), "score", "category_id", F.lit(None).cast("string").alias("category_name"))
    return d.groupBy("file_name").agg(F.collect_list(box).alias("boxes"), F.lit(None).cast("string").alias("gps"))


R.add("flatten_predictions", "fx_det", lambda d: cv.flatten_predictions(_nested(d)).select("file_name", "x_min", "y_min", "x_max", "y_max", "score", "area"), f"{with_tables('fx_det')}\nSELECT file_name, CAST(x_min AS DOUBLE) AS x_min, CAST(y_min AS DOUBLE) AS y_min, CAST(x_max AS DOUBLE) AS x_max, CAST(y_max AS DOUBLE) AS y_max, round(score, 6) AS score, CAST((x_max - x_min) * (y_max - y_min) AS DOUBLE) AS area FROM fx_det")

# labels
R.add("filter_labels", "fx_gt fx_label_map", lambda g, m: labels.filter_labels(labels.map_labels(g, m), ("buffalo", "impala", "roan"), ("sable",)).select("annotation_id", "category_name"), f"{with_tables('fx_gt', 'fx_label_map')}\nSELECT annotation_id, category_name FROM fx_gt JOIN fx_label_map USING (category_id) WHERE category_name IN ('buffalo', 'impala', 'roan')")
R.add("map_labels", "fx_gt fx_label_map", lambda g, m: labels.map_labels(g, m.filter("category_id < 4")).select("annotation_id", "category_name"), f"{with_tables('fx_gt', 'fx_label_map')}\nSELECT annotation_id, category_name FROM fx_gt LEFT JOIN (SELECT * FROM fx_label_map WHERE category_id < 4) m USING (category_id)")
R.add("dense_label_map", "fx_gt fx_label_map", lambda g, m: g.join(labels.dense_label_map(m, discard=("impala", "nyala(m)")), "category_id").select("annotation_id", "category_name", "new_id"), f"{with_tables('fx_gt', 'fx_label_map')}\nSELECT annotation_id, category_name, CAST(new_id AS INT) AS new_id FROM fx_gt JOIN (SELECT *, row_number() OVER (ORDER BY category_id) - 1 AS new_id FROM fx_label_map WHERE category_name NOT IN ('impala', 'nyala(m)')) m USING (category_id)")
R.add("single_class", "fx_gt", lambda g: labels.single_class(g).groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n")), f"{with_tables('fx_gt')}\nSELECT image_id, CAST(0 AS INT) AS category_id, count(*) AS n FROM fx_gt GROUP BY image_id")
R.add("drop_result_label", "fx_task_results", lambda t: labels.drop_result_label(t.groupBy("task_id").agg(F.collect_list(F.struct("result_id", "label")).alias("result")), "click").select("task_id", F.explode("result").alias("r")).select("task_id", "r.result_id"), f"{with_tables('fx_task_results')}\nSELECT task_id, result_id FROM fx_task_results QUALIFY label <> 'click' OR count(*) OVER (PARTITION BY task_id) = 1")
R.add("non_empty_images", "fx_images fx_gt", lambda i, g: labels.non_empty(i, g).select("file_name"), f"{with_tables('fx_images', 'fx_gt')}\nSELECT file_name FROM fx_images WHERE image_id IN (SELECT image_id FROM fx_gt)")
R.add("empty_images", "fx_images fx_gt", lambda i, g: labels.all_but(i, labels.non_empty(i, g)), f"{with_tables('fx_images', 'fx_gt')}\nSELECT DISTINCT file_name FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_gt)")
R.add("keep_first", "fx_gt", lambda g: labels.keep_first(g, ["image_id", "category_id"], ["annotation_id"]).select("image_id", "category_id", "annotation_id"), f"{with_tables('fx_gt')}\nSELECT image_id, category_id, min(annotation_id) AS annotation_id FROM fx_gt GROUP BY ALL")
R.add("first_tasks", "fx_task_results", lambda t: labels.first_tasks(t.select("task_id").distinct(), 100), f"{with_tables('fx_task_results')}\nSELECT DISTINCT task_id FROM fx_task_results ORDER BY task_id LIMIT 100")

# statistics
_NAMED = "FROM fx_gt JOIN fx_label_map USING (category_id) GROUP BY category_name"
R.add("instances_per_class", "fx_gt fx_label_map", stats.instances_per_class, f"{with_tables('fx_gt', 'fx_label_map')}\nSELECT category_name AS class, count(*) AS n {_NAMED}")
R.add("images_per_class", "fx_gt fx_label_map", stats.images_per_class, f"{with_tables('fx_gt', 'fx_label_map')}\nSELECT category_name AS class, count(DISTINCT image_id) AS n {_NAMED}")
R.add("rows_per_class", "fx_gt fx_label_map", stats.rows_per_class, R.oracle["instances_per_class"])
R.add("top_classes", "fx_gt fx_label_map", lambda g, m: stats.top_classes(stats.instances_per_class(g, m), 3), f"{R.oracle['instances_per_class']} ORDER BY n DESC, class LIMIT 3")
R.add("split_balance", "fx_images fx_gt", stats.split_balance, f"{with_tables('fx_images', 'fx_gt')},\nh AS (SELECT split, image_id IN (SELECT image_id FROM fx_gt) AS has FROM fx_images)\nSELECT coalesce(split, 'all') AS split, count(*) AS images, count(*) FILTER (WHERE has) AS non_empty, count(*) FILTER (WHERE NOT has) AS empty FROM h GROUP BY ROLLUP (split)")
R.add("class_by_dir", "fx_images fx_gt", lambda i, g: stats.class_by_dir(i, g, NAMES), f"{with_tables('fx_images', 'fx_gt')}\nSELECT image_dir, {', '.join(f'count(*) FILTER (WHERE category_id = {k}) AS \"{v}\"' for k, v in NAMES.items())} FROM fx_gt JOIN fx_images USING (image_id) GROUP BY image_dir")
R.add("project_stats", "fx_task_results", stats.project_stats, f"{with_tables('fx_task_results')}\nSELECT project_id, label, count(*) AS instances, count(DISTINCT task_id) AS images FROM fx_task_results GROUP BY ALL")
R.add("annotator_stats", "fx_task_results", stats.annotator_stats, f"{with_tables('fx_task_results')}\nSELECT project_id, annotator_id, label, count(*) AS instances, count(DISTINCT task_id) AS images FROM fx_task_results GROUP BY ALL")
R.add("class_weights", "fx_gt fx_images", stats.class_weights, f"{with_tables('fx_gt', 'fx_images')},\nt AS (SELECT (SELECT count(*) FROM fx_gt) + least((SELECT count(*) FROM fx_gt), (SELECT count(*) FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_gt))) AS total),\nf AS (SELECT category_id + 1 AS category_id, count(*) / CAST((SELECT total FROM t) AS DOUBLE) AS freq FROM fx_gt GROUP BY ALL)\nSELECT category_id, round(freq, 6) AS freq, round(1 / (freq + 1e-6), 6) AS weight FROM f UNION ALL SELECT 0, NULL, 1e0")

# tiles
_AXES = """ax AS (SELECT image_id, file_name, width, height, unnest(range(0, CAST(greatest(ceil((width - 640) / 512e0), 0) AS INT) + 1)) AS ix FROM fx_images),
ay AS (SELECT *, unnest(range(0, CAST(greatest(ceil((height - 640) / 512e0), 0) AS INT) + 1)) AS iy FROM ax),
tiles AS (SELECT image_id, file_name, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(greatest(least(ix * 512, width - 640), 0) AS INT) AS x0, CAST(greatest(least(iy * 512, height - 640), 0) AS INT) AS y0,
  CAST(least(greatest(least(ix * 512, width - 640), 0) + 640, width) AS INT) AS x1, CAST(least(greatest(least(iy * 512, height - 640), 0) + 640, height) AS INT) AS y1 FROM ay)"""
_BOXED = """tb AS (SELECT g.annotation_id, t.image_id, g.category_id, t.ix, t.iy, t.x0, t.y0, t.x1, t.y1, greatest(g.x_min, t.x0) - t.x0 AS x_min, greatest(g.y_min, t.y0) - t.y0 AS y_min,
  least(g.x_max, t.x1) - greatest(g.x_min, t.x0) AS w, least(g.y_max, t.y1) - greatest(g.y_min, t.y0) AS h
  FROM fx_gt g JOIN tiles t ON t.image_id = g.image_id AND t.x0 < g.x_max AND t.x1 > g.x_min AND t.y0 < g.y_max AND t.y1 > g.y_min
  WHERE CAST((least(g.x_max, t.x1) - greatest(g.x_min, t.x0)) * (least(g.y_max, t.y1) - greatest(g.y_min, t.y0)) AS DOUBLE) / ((g.x_max - g.x_min) * (g.y_max - g.y_min)) >= 0.8e0)"""
_T = f"{with_tables('fx_images', 'fx_gt')},\n{_AXES},\n{_BOXED}"
R.add("tile_grid", "fx_images", tiling.tile_grid, f"{with_tables('fx_images')},\n{_AXES}\nSELECT * FROM tiles")
R.add("tile_boxes", "fx_gt", tiling.assign_boxes_to_tiles, f"{_T}\nSELECT * FROM tb")
R.add("tiles_with_annotations", "fx_images fx_gt", lambda i, g: tiling.tiles_with_annotations(i, g).select("file_name", "x0", "y0", "x1", "y1", "annotation_id", "x", "y"), f"{_T}\nSELECT t.file_name, t.x0, t.y0, t.x1, t.y1, annotation_id, round(x_min + w / 2e0, 6) AS x, round(y_min + h / 2e0, 6) AS y FROM tiles t LEFT JOIN tb ON t.image_id = tb.image_id AND t.ix = tb.ix AND t.iy = tb.iy")
R.add("distinct_tiles", "fx_images fx_gt", lambda i, g: tiling.distinct_tiles(tiling.tiles_with_annotations(i, g)).select("file_name", "x0", "y0", "x1", "y1"), f"{with_tables('fx_images')},\n{_AXES}\nSELECT DISTINCT file_name, x0, y0, x1, y1 FROM tiles")
R.add(
    "sample_tiles",
    "fx_images fx_gt",
    lambda i, g: tiling.sample_tiles(tiling.tiles_with_annotations(i, g), 0.5).select("file_name", "x0", "y0", "annotation_id"),
    f"{_T},\nj AS (SELECT t.file_name, t.image_id, t.ix, t.iy, t.x0, t.y0, annotation_id FROM tiles t LEFT JOIN tb ON t.image_id = tb.image_id AND t.ix = tb.ix AND t.iy = tb.iy),\nn AS (SELECT CAST(floor(count(*) * 0.5e0) AS BIGINT) AS n FROM (SELECT DISTINCT image_id, ix, iy FROM j WHERE annotation_id IS NOT NULL)),\ne AS (SELECT *, row_number() OVER (ORDER BY md5(concat('41:', file_name, '_', x0, '_', y0))) AS k FROM j WHERE annotation_id IS NULL)\nSELECT file_name, x0, y0, annotation_id FROM j WHERE annotation_id IS NOT NULL UNION ALL SELECT file_name, x0, y0, annotation_id FROM e WHERE k <= (SELECT n FROM n)",
)
R.add("ratio_grid", "fx_images", lambda i: tiling.ratio_grid(i, 0.5, 0.5).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("x1").alias("x1")), f"{with_tables('fx_images')}\nSELECT image_id, CAST(4 AS BIGINT) AS n, width AS x1 FROM fx_images")
R.add("normalise_by_tile", "fx_gt", lambda g: cv.normalise_by_tile(tiling.assign_boxes_to_tiles(g).withColumnsRenamed({"w": "width", "h": "height"})).select("annotation_id", "ix", "iy", "x", "y", "w", "h", "in_range"), f"{_T}\nSELECT annotation_id, ix, iy, round((x_min + w / 2e0) / 640, 8) AS x, round((y_min + h / 2e0) / 640, 8) AS y, round(w / 640e0, 8) AS w, round(h / 640e0, 8) AS h, true AS in_range FROM tb", 8)
R.add("tile_to_image", "fx_gt", lambda g: cv.tile_to_image_coords(tiling.assign_boxes_to_tiles(g, min_area_ratio=1.0).withColumns({"x_max": F.col("x_min") + F.col("w"), "y_max": F.col("y_min") + F.col("h")})).select("annotation_id", "x_min", "y_min", "x_max", "y_max").distinct(), f"{_T}\nSELECT DISTINCT g.annotation_id, g.x_min, g.y_min, g.x_max, g.y_max FROM fx_gt g JOIN tb ON g.annotation_id = tb.annotation_id AND tb.w = g.x_max - g.x_min AND tb.h = g.y_max - g.y_min")
R.add("crop_manifest", "fx_det", lambda d: tiling.crop_manifest(d.filter("score >= 0.7"), "false_positive", "det_id").select("path", "x1", "y1", "x2", "y2", "crop_name"), f"{with_tables('fx_det')},\n{_EXPAND.replace('SRC', 'fx_det')}\nSELECT file_name AS path, {_int('x1')} AS x1, {_int('y1')} AS y1, {_int('least(x_max + 0.5e0 * (x_max - x1), width)')} AS x2, {_int('least(y_max + 0.5e0 * (y_max - y1), height)')} AS y2, concat(regexp_extract(file_name, '([^/]+)\\.jpg$', 1), '-', det_id, '.jpg') AS crop_name FROM x1 WHERE score >= 0.7e0")

# samples
_POS = "m AS (SELECT *, image_id IN (SELECT image_id FROM fx_gt) AS positive FROM fx_images),\nc AS (SELECT image_dir, count(*) FILTER (WHERE positive) AS n FROM m GROUP BY image_dir),\nk AS (SELECT m.*, n, row_number() OVER (PARTITION BY m.image_dir, positive ORDER BY md5('41:' || file_name), file_name) AS k FROM m JOIN c USING (image_dir))"
R.add("sample_pos_neg", "fx_images fx_gt", lambda i, g: sampling.sample_pos_neg(i, g, 0.1).select("file_name", "positive"), f"{with_tables('fx_images', 'fx_gt')},\n{_POS}\nSELECT file_name, positive FROM k WHERE positive OR k <= floor(n * 0.1e0)")
R.add("sample_empties", "fx_images fx_gt", lambda i, g: sampling.sample_empties(i, g, ratio=0.02).select("file_name"), f"{with_tables('fx_images', 'fx_gt')}\nSELECT file_name FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_gt) QUALIFY row_number() OVER (ORDER BY md5('41:' || file_name), file_name) <= (SELECT floor(count(*) * 0.02e0) FROM fx_gt)")
R.add("staged_subsets", "fx_images fx_gt", lambda i, g: sampling.staged_subsets(i, g, (0.0, 0.05, 0.1)).select("ratio", "file_name"), f"{with_tables('fx_images', 'fx_gt')},\n{_POS}\nSELECT r AS ratio, file_name FROM k CROSS JOIN (SELECT unnest([0e0, 0.05e0, 0.1e0]) AS r) WHERE positive OR k <= floor(n * r)")

# names
R.add("label_paths", "fx_images", lambda i: i.select("image_id", paths.label_path(F.col("file_name")).alias("label_path")), f"{with_tables('fx_images')}\nSELECT image_id, regexp_replace(replace(file_name, 'images', 'labels'), '\\.[^.]+$', '.txt') AS label_path FROM fx_images")
_TNAME = "concat(regexp_extract(file_name, '([^/]+)\\.jpg$', 1), '_', CAST(ix AS VARCHAR), '_', CAST(x0 AS VARCHAR), '_', CAST(y0 AS VARCHAR), '_', CAST(x1 AS VARCHAR), '_', CAST(y1 AS VARCHAR), '.jpg')"
R.add(
    "parse_tile_names",
    "fx_images",
    lambda i: tiling.tile_grid(i).select(F.concat_ws("_", paths.stem(F.col("file_name")), "ix", "x0", "y0", "x1", "y1").alias("t")).select(F.concat("t", F.lit(".jpg")).alias("name")).select("name", *(c.alias(k) for k, c in paths.parse_tile_name(F.col("name")).items())),
    f"{with_tables('fx_images')},\n{_AXES}\nSELECT {_TNAME} AS name, x0, y0, x1, y1, regexp_extract(file_name, '[^/]+$') AS parent FROM tiles",
)
R.add("decoded_names", "fx_images", lambda i: i.select("image_id", paths.decoded_name(F.replace(F.replace("file_name", F.lit("/"), F.lit("%2F")), F.lit("IMG_"), F.lit("IMG%20+"))).alias("name")), f"{with_tables('fx_images')}\nSELECT image_id, concat('IMG +', lpad(CAST(image_id AS VARCHAR), 8, '0'), '.jpg') AS name FROM fx_images")
R.add("task_urls", "fx_images", lambda i: i.select("image_id", paths.task_image_url(F.concat(F.lit("/mnt/a b/"), "file_name"), "/mnt/").alias("url")), f"{with_tables('fx_images')}\nSELECT image_id, concat('/data/local-files/?d=a%20b/', file_name) AS url FROM fx_images")
R.add("short_names", "fx_images", lambda i: i.select("image_id", paths.posix_tail(F.replace("file_name", F.lit("/"), F.lit("\\"))).alias("tail"), paths.flat_coco_name(F.col("file_name")).alias("flat")), f"{with_tables('fx_images')}\nSELECT image_id, regexp_extract(file_name, '[^/]+/[^/]+$') AS tail, concat(split_part(file_name, '/', 2), '#', split_part(file_name, '/', 1), '#', split_part(file_name, '/', 3)) AS flat FROM fx_images")
R.add("common_upload_dir", "fx_images", lambda i: paths.common_upload_dir(i, "file_name"), f"""{with_tables('fx_images')},
d AS (SELECT DISTINCT regexp_replace(file_name, '/?[^/]*$', '') AS p FROM fx_images),
n AS (SELECT unnest(range(0, (SELECT min(length(p)) FROM d) + 1)) AS k)
SELECT CASE WHEN (SELECT count(*) FROM d) = 1 THEN (SELECT min(p) FROM d) ELSE (SELECT substr(any_value(p), 1, max(k)) FROM (SELECT min(p) AS p, k FROM d CROSS JOIN n GROUP BY k HAVING count(DISTINCT substr(p, 1, k)) = 1)) END AS common_dir""")

# positions
_GEO = f"""{with_tables('fx_meta', 'fx_det')},
p AS (SELECT *, CASE WHEN lat_ref IN ('S', 'W') THEN -1 ELSE 1 END * (lat_deg + lat_min / 60e0 + lat_sec / 3600e0) AS lat, CASE WHEN lon_ref IN ('S', 'W') THEN -1 ELSE 1 END * (lon_deg + lon_min / 60e0 + lon_sec / 3600e0) AS lon,
  CASE WHEN camera_model = 'ZenmuseP1' THEN round(18000e0 * (24e0 / 10) / ((focal_mm / 10) * exif_height), 3) END AS gsd_cm FROM fx_meta),
k AS (SELECT 6378137e0 AS a, 0.00669438e0 AS e, 0.00669438e0 / (1 - 0.00669438e0) AS q, (1 - sqrt(1 - 0.00669438e0)) / (1 + sqrt(1 - 0.00669438e0)) AS f),
px AS (SOURCE),
z AS (SELECT *, floor((lon + 180) / 6) % 60 + 1 AS zone, coalesce(gsd_cm / 100, 0.026e0) AS g, radians(lat) AS phi FROM px),
u1 AS (SELECT z.*, k.*, radians((zone - 1) * 6 - 177) AS cm, a / sqrt(1 - e * power(sin(phi), 2)) AS n, power(tan(phi), 2) AS t, q * power(cos(phi), 2) AS c, cos(phi) * (radians(lon) - radians((zone - 1) * 6 - 177)) AS l,
  a * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * phi - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * phi) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * phi) - (35 * e * e * e / 3072) * sin(6 * phi)) AS m FROM z, k),
u2 AS (SELECT *, 0.9996e0 * n * (l + (1 - t + c) * power(l, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * power(l, 5) / 120) + (vx - exif_width / 2e0) * g AS x,
  0.9996e0 * (m + n * tan(phi) * (power(l, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(l, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * power(l, 6) / 720)) + (exif_height / 2e0 - vy) * g AS y FROM u1),
u3 AS (SELECT *, y / 0.9996e0 / (a * (1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256)) AS mu FROM u2),
u4 AS (SELECT *, mu + (3 * f / 2 - 27 * power(f, 3) / 32) * sin(2 * mu) + (21 * f * f / 16 - 55 * power(f, 4) / 32) * sin(4 * mu) + (151 * power(f, 3) / 96) * sin(6 * mu) + (1097 * power(f, 4) / 512) * sin(8 * mu) AS b FROM u3),
u5 AS (SELECT *, q * power(cos(b), 2) AS c1, power(tan(b), 2) AS t1, a / sqrt(1 - e * power(sin(b), 2)) AS n1, a * (1 - e) / power(1 - e * power(sin(b), 2), 1.5e0) AS r1 FROM u4),
u6 AS (SELECT *, x / (n1 * 0.9996e0) AS d FROM u5),
u7 AS (SELECT *, degrees(b - n1 * tan(b) / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * q) * power(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * q - 3 * c1 * c1) * power(d, 6) / 720)) AS px_lat,
  degrees(cm + (d - (1 + 2 * t1 + c1) * power(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * q + 24 * t1 * t1) * power(d, 5) / 120) / cos(b)) AS px_lon FROM u6)"""
_POINT = _GEO.replace("SOURCE", "SELECT *, exif_width * 0.25e0 AS vx, exif_height * 0.75e0 AS vy FROM p")
_DETS = _GEO.replace("SOURCE", "SELECT det_id, p.*, (x_min + x_max) / 2e0 AS vx, (y_min + y_max) / 2e0 AS vy FROM fx_det LEFT JOIN p USING (image_id)")
R.add("gps_decimal", "fx_meta", lambda m: geo.with_positions(m).select("image_id", "lat", "lon", geo.altitude_reference(F.col("altitude_ref")).alias("altitude_reference")), f"{_POINT}\nSELECT image_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE altitude_ref WHEN 0 THEN 'Above sea level' WHEN 1 THEN 'Below sea level' ELSE 'Unknown' END AS altitude_reference FROM p")
R.add("gsd", "fx_meta", lambda m: geo.with_positions(m).select("image_id", "gsd_cm"), f"{_POINT}\nSELECT image_id, gsd_cm FROM p")
R.add("pixel_to_latlon", "fx_meta", lambda m: geo.pixel_to_latlon(geo.with_positions(m), F.col("exif_width") * 0.25, F.col("exif_height") * 0.75).select("image_id", "px_lat", "px_lon"), f"{_POINT}\nSELECT image_id, round(px_lat, 6) AS px_lat, round(px_lon, 6) AS px_lon FROM u7")
R.add("geotag_detections", "fx_det fx_meta", lambda d, m: geo.geotag_detections(d, m).select("det_id", "px_lat", "px_lon"), f"{_DETS}\nSELECT det_id, round(px_lat, 6) AS px_lat, round(px_lon, 6) AS px_lon FROM u7")

# checks
R.add(
    "quality_report",
    "fx_yolo fx_images",
    lambda y, i: checks.quality_report(y.withColumn("w", F.when(F.col("annotation_id") % 50 == 0, F.lit(1.5)).otherwise(F.col("w"))), i),
    f"{with_tables('fx_yolo', 'fx_images')},\ny AS (SELECT * REPLACE (CASE WHEN annotation_id % 50 = 0 THEN 1.5e0 ELSE w END AS w) FROM fx_yolo)\n"
    + " UNION ALL ".join(f"SELECT '{c}_out_of_range' AS \"check\", count(*) FILTER (WHERE {c} < 0 OR {c} > 1) AS n_bad FROM y UNION ALL SELECT '{c}_null', count(*) FILTER (WHERE {c} IS NULL) FROM y" for c in "xywh")
    + " UNION ALL SELECT 'image_missing', count(*) FROM y WHERE image_id NOT IN (SELECT image_id FROM fx_images) UNION ALL SELECT 'image_without_boxes', count(*) FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM y)",
)
R.add("missing_parents", "fx_images", lambda i: checks.missing_parents(i.select(F.replace("file_name", F.lit("camp3"), F.lit("lost")).alias("parent")), i), f"{with_tables('fx_images')}\nSELECT replace(file_name, 'camp3', 'lost') AS parent FROM fx_images WHERE file_name LIKE 'camp3%'")
R.add("tasks_without_boxes", "fx_task_results", lambda t: checks.tasks_without_boxes(t.select("task_id").distinct(), t.filter("label <> 'click'")), f"{with_tables('fx_task_results')}\nSELECT DISTINCT task_id FROM fx_task_results WHERE task_id NOT IN (SELECT task_id FROM fx_task_results WHERE label <> 'click')")
R.add("projects_per_file", "fx_task_results", lambda t: checks.projects_per_file(t.withColumn("file_path", F.expr("concat('f', task_id div 3)"))), f"{with_tables('fx_task_results')}\nSELECT concat('f', CAST(task_id // 3 AS VARCHAR)) AS file_path, count(DISTINCT project_id) AS n_projects FROM fx_task_results GROUP BY 1 HAVING count(DISTINCT project_id) > 1")
QUERIES, ORACLE = R.queries, R.oracle
