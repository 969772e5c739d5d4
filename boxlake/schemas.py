"""Fixed schemas of the tables: what the readers give and the operators take."""

from __future__ import annotations

IMAGES = "image_id bigint, file_name string, image_dir string, width int, height int, split string"
GROUND_TRUTH = "annotation_id bigint, image_id bigint, file_name string, width int, height int, category_id int, x_min int, y_min int, x_max int, y_max int"
DETECTIONS = "det_id bigint, image_id bigint, file_name string, width int, height int, category_id int, x_min int, y_min int, x_max int, y_max int, score double"
YOLO = "annotation_id bigint, image_id bigint, file_name string, category_id int, x double, y double, w double, h double"
OBB = "annotation_id bigint, image_id bigint, file_name string, category_id int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double"
POLYGONS = "polygon_id bigint, image_id bigint, width int, height int, points array<struct<x:double,y:double>>"
POINTS = "images string, x double, y double, labels int"
IMAGE_META = "image_id bigint, file_name string, exif_width int, exif_height int, camera_model string, focal_mm double, lat_deg int, lat_min int, lat_sec double, lat_ref string, lon_deg int, lon_min int, lon_sec double, lon_ref string, altitude_m double, altitude_ref int"
TASK_RESULTS = "result_id bigint, task_id bigint, project_id int, annotator_id bigint, label string, ts timestamp"
LABEL_MAP = "category_id int, category_name string"
