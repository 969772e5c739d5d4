"""Conversions between box, oriented-box, polygon, point and percent forms; all stateless but for joins
with image sizes and label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.operators.checks import check_parameters
from boxlake.operators.ordered import with_place

CORNERS = tuple(f"{a}{i}" for i in (1, 2, 3, 4) for a in "xy")


def _whole(c: Column) -> Column:
    """Truncated towards zero."""
    return c.cast("int")


def yolo_to_obb(df: DataFrame) -> DataFrame:
    """x, y, w, h to corners clockwise from the top left."""
    x0, x1 = F.col("x") - F.col("w") / 2, F.col("x") + F.col("w") / 2
    y0, y1 = F.col("y") - F.col("h") / 2, F.col("y") + F.col("h") / 2
    return df.withColumns(dict(zip(CORNERS, (x0, y0, x1, y0, x1, y1, x0, y1), strict=True))).drop("x", "y", "w", "h")


def obb_to_yolo(df: DataFrame) -> DataFrame:
    """Axis-aligned corners to centre and size."""
    return df.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y4")) / 2, "w": F.col("x2") - F.col("x1"), "h": F.col("y4") - F.col("y1")}).drop(*CORNERS)


def obb_to_dota(df: DataFrame, images: DataFrame, label_map: DataFrame) -> DataFrame:
    """Corners in whole pixels, label name and difficulty 0; boxes of unknown images or labels drop out."""
    sized = df.join(images.select("image_id", "width", "height"), "image_id").join(label_map, "category_id")
    scaled = {c: _whole(F.col(c) * F.col("width" if c[0] == "x" else "height")) for c in CORNERS}
    return sized.withColumns(scaled).withColumns({"label_name": F.col("category_name"), "difficulty": F.lit(0)}).drop("width", "height", "category_name")


def yolo_to_coco(df: DataFrame, images: DataFrame) -> DataFrame:
    """bbox_x, bbox_y, bbox_w, bbox_h, area, iscrowd: each edge is truncated, sizes are their differences."""
    sized = df.join(images.select("image_id", "width", "height"), "image_id")
    edges = {"x_min": (F.col("x") - F.col("w") / 2) * F.col("width"), "y_min": (F.col("y") - F.col("h") / 2) * F.col("height"), "x_max": (F.col("x") + F.col("w") / 2) * F.col("width"), "y_max": (F.col("y") + F.col("h") / 2) * F.col("height")}
    cut = sized.withColumns({k: _whole(v) for k, v in edges.items()})
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    out = cut.withColumns({"bbox_x": F.col("x_min"), "bbox_y": F.col("y_min"), "bbox_w": w, "bbox_h": h, "area": w * h, "iscrowd": F.lit(0)})
    return out.withColumn("segmentation", F.array("x_min", "y_min", "x_max", "y_min", "x_max", "y_max", "x_min", "y_max")).drop("x", "y", "w", "h", "width", "height", "x_min", "y_min", "x_max", "y_max")


def sequential_ids(df: DataFrame, group: str, order: list[str], name: str = "id") -> DataFrame:
    """0, 1, 2 ... by group, then order; a null group comes first."""
    return with_place(df, [group, *order], name)


def denormalise_boxes(df: DataFrame, images: DataFrame) -> DataFrame:
    """Yolo boxes to corners in pixels, with x_min, y_min, x_max, y_max from the first and third corner."""
    corners = yolo_to_obb(df).join(images.select("image_id", "width", "height"), "image_id")
    out = corners.withColumns({c: F.col(c) * F.col("width" if c[0] == "x" else "height") for c in CORNERS})
    return out.withColumns({"x_min": F.col("x1"), "y_min": F.col("y1"), "x_max": F.col("x2"), "y_max": F.col("y3")})


def to_point_annotations(df: DataFrame, images: DataFrame) -> DataFrame:
    """Centre and size in pixels; labels move up by one, 0 being the background."""
    sized = df.join(images.select("image_id", "width", "height"), "image_id")
    return sized.select("annotation_id", F.col("file_name").alias("images"), (F.col("category_id") + 1).alias("labels"), *((F.col(c) * F.col("width" if c in "xw" else "height")).alias(c) for c in "xywh"))


def blank_points(images: DataFrame) -> DataFrame:
    """A point at 0, 0 with the background's label for images without labels."""
    return images.select(F.col("file_name").alias("images"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("labels"))


def corners_to_aabb(df: DataFrame) -> DataFrame:
    xs, ys = [F.col(f"x{i}") for i in (1, 2, 3, 4)], [F.col(f"y{i}") for i in (1, 2, 3, 4)]
    return df.withColumns({"x_min": F.least(*xs), "y_min": F.least(*ys), "x_max": F.greatest(*xs), "y_max": F.greatest(*ys)})


def normalise_by_tile(df: DataFrame, tile: int = 640) -> DataFrame:
    """Centre and size over the tile's sides, and whether all lie in 0 to 1."""
    out = df.withColumns({"x": (F.col("x_min") + F.col("width") / 2) / tile, "y": (F.col("y_min") + F.col("height") / 2) / tile, "w": F.col("width") / tile, "h": F.col("height") / tile})
    return out.withColumn("in_range", F.greatest("x", "y", "w", "h") <= 1)


def normalise_by_image(df: DataFrame, classes: str = "keep") -> DataFrame:
    """Boxes over their image's size. classes: keep, zero (one class) or shift (the least class becomes 0)."""
    if classes not in ("keep", "zero", "shift"):
        raise ValueError(f"classes must be keep, zero or shift, not {classes!r}")
    out = df.withColumns({"x": (F.col("x_min") + F.col("x_max")) / 2 / F.col("width"), "y": (F.col("y_min") + F.col("y_max")) / 2 / F.col("height"), "w": (F.col("x_max") - F.col("x_min")) / F.col("width"), "h": (F.col("y_max") - F.col("y_min")) / F.col("height")})
    if classes == "zero":
        return out.withColumn("category_id", F.lit(0))
    if classes == "shift":
        least = df.agg(F.min("category_id").alias("__least"))
        return out.crossJoin(F.broadcast(least)).withColumn("category_id", F.col("category_id") - F.col("__least")).drop("__least")
    return out


def relative_boxes(df: DataFrame) -> DataFrame:
    """x, y, w, h of the top-left corner and size in 0 to 1."""
    return df.withColumns({"x": F.col("x_min") / F.col("width"), "y": F.col("y_min") / F.col("height"), "w": (F.col("x_max") - F.col("x_min")) / F.col("width"), "h": (F.col("y_max") - F.col("y_min")) / F.col("height")})


def percent_columns(df: DataFrame) -> DataFrame:
    """px, py, pw, ph: a box as percents of its image."""
    return df.withColumns({"px": 100 * F.col("x_min") / F.col("width"), "py": 100 * F.col("y_min") / F.col("height"), "pw": 100 * (F.col("x_max") - F.col("x_min")) / F.col("width"), "ph": 100 * (F.col("y_max") - F.col("y_min")) / F.col("height")})


def box_to_percent_result(df: DataFrame, label: str = "category_name", score: str | None = "score") -> DataFrame:
    """A labelling result per box: percent value, rotation 0, labels, original size; a missing score is 0."""
    p = percent_columns(df)
    value = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pw").alias("width"), F.col("ph").alias("height"), F.lit(0).alias("rotation"), F.array(label).alias("rectanglelabels"))
    parts = [F.col("width").alias("original_width"), F.col("height").alias("original_height"), F.lit(0).alias("image_rotation"), F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), F.lit("rectanglelabels").alias("type"), value.alias("value")]
    if score:
        parts.append(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    return p.withColumn("result", F.struct(*parts)).drop("px", "py", "pw", "ph")


def percent_result_to_box(df: DataFrame) -> DataFrame:
    """px, py, pw, ph and the image's size to x_min, y_min, x_max, y_max in pixels."""
    x0, y0 = F.col("px") * F.col("width") / 100, F.col("py") * F.col("height") / 100
    return df.withColumns({"x_min": x0, "y_min": y0, "x_max": x0 + F.col("pw") * F.col("width") / 100, "y_max": y0 + F.col("ph") * F.col("height") / 100}).drop("px", "py", "pw", "ph")


def polygon_to_bbox(df: DataFrame, points: str = "points") -> DataFrame:
    """Edges truncated and not below 0; the centre is that of the unclipped bounds, the size that of the clipped."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    edge = lambda c: F.greatest(_whole(c), F.lit(0))
    out = df.withColumns({"x_min": edge(F.array_min(xs)), "y_min": edge(F.array_min(ys)), "x_max": edge(F.array_max(xs)), "y_max": edge(F.array_max(ys)), "x": (F.array_min(xs) + F.array_max(xs)) / 2, "y": (F.array_min(ys) + F.array_max(ys)) / 2})
    return out.withColumns({"bbox_w": F.col("x_max") - F.col("x_min"), "bbox_h": F.col("y_max") - F.col("y_min")})


def polygon_to_percent(df: DataFrame, points: str = "points") -> DataFrame:
    return df.withColumn(points, F.transform(points, lambda p: F.struct((100 * p["x"] / F.col("width")).alias("x"), (100 * p["y"] / F.col("height")).alias("y"))))


def polygon_to_seg_row(df: DataFrame, points: str = "points", value: str = "pixel_value", n_classes: int | None = None) -> DataFrame:
    """A text row `class x1 y1 ... xn yn` over the image's size, rounded to 6; the class is the pixel value less
    one. Contours of fewer than 3 points and unknown values drop out."""
    known = F.col(value) >= 1 if n_classes is None else F.col(value).between(1, n_classes)
    flat = F.flatten(F.transform(points, lambda p: F.array(F.round(p["x"] / F.col("width"), 6), F.round(p["y"] / F.col("height"), 6))))
    return df.filter((F.size(points) >= 3) & known).withColumn("value", F.concat_ws(" ", (F.col(value) - 1).cast("string"), F.array_join(F.transform(flat, lambda v: v.cast("string")), " ")))


def polygon_to_oriented_box(df: DataFrame, points: str = "points") -> DataFrame:
    """cx, cy, w, h, angle of four corners in order: w is the first edge, angle its direction in radians
    (x axis to y axis). Polygons without four corners or with an empty edge drop out."""
    p = lambda i: F.col(points)[i]
    length = lambda a, b: F.hypot(p(b)["x"] - p(a)["x"], p(b)["y"] - p(a)["y"])
    four = df.filter(F.size(points) == 4)
    out = four.withColumns({"cx": sum((p(i)["x"] for i in range(1, 4)), p(0)["x"]) / 4, "cy": sum((p(i)["y"] for i in range(1, 4)), p(0)["y"]) / 4, "w": length(0, 1), "h": length(1, 2), "angle": F.atan2(p(1)["y"] - p(0)["y"], p(1)["x"] - p(0)["x"])})
    return out.filter("w > 0 AND h > 0")


def xyxy_to_coco_result(df: DataFrame) -> DataFrame:
    """image_id, category_id, bbox, score, each box with its own score."""
    return df.select("image_id", "category_id", F.array("x_min", "y_min", F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")).alias("bbox"), "score")


def int_bbox(df: DataFrame) -> DataFrame:
    return df.withColumn("bbox", F.transform("bbox", lambda v: v.cast("int")))


def flatten_predictions(df: DataFrame) -> DataFrame:
    """file_name, boxes (array of structs bbox, score, category_id, category_name), gps to one row per box;
    boxes with fewer than 5 known values drop out."""
    rows = df.select("file_name", "gps", F.explode("boxes").alias("b")).select("file_name", "gps", F.col("b.bbox")[0].alias("x_min"), F.col("b.bbox")[1].alias("y_min"), F.col("b.bbox")[2].alias("bbox_w"), F.col("b.bbox")[3].alias("bbox_h"), "b.score", "b.category_id", "b.category_name")
    full = rows.dropna(thresh=5, subset=["file_name", "x_min", "y_min", "bbox_w", "bbox_h", "score", "category_id", "category_name"])
    return full.withColumns({"x_max": F.col("x_min") + F.col("bbox_w"), "y_max": F.col("y_min") + F.col("bbox_h"), "area": F.col("bbox_w") * F.col("bbox_h")})


def expand_box(df: DataFrame, factor: float = 2.0, mode: str = "chained") -> DataFrame:
    """Boxes grown about their centre, clipped to the image, truncated: x1, y1, x2, y2.

    A box grows by (factor - 1) / 2 of its size at every edge; mode 'chained' moves the far edges after the near
    ones and takes the size from these, moved and clipped, to the old far edge.
    """
    check_parameters(factor=factor)
    if mode not in ("chained", "symmetric"):
        raise ValueError(f"mode must be chained or symmetric, not {mode!r}")
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    grow = F.lit((factor - 1) / 2)
    x1, y1 = F.greatest(F.col("x_min") - grow * w, F.lit(0.0)), F.greatest(F.col("y_min") - grow * h, F.lit(0.0))
    if mode == "chained":
        w, h = F.col("x_max") - x1, F.col("y_max") - y1
    x2, y2 = F.least(F.col("x_max") + grow * w, F.col("width").cast("double")), F.least(F.col("y_max") + grow * h, F.col("height").cast("double"))
    return df.withColumns({"x1": _whole(x1), "y1": _whole(y1), "x2": _whole(x2), "y2": _whole(y2)})


def tile_to_image_coords(df: DataFrame) -> DataFrame:
    """Boxes in a tile moved by the tile's x0, y0."""
    return df.withColumns({c: F.col(c) + F.col("x0" if c[0] == "x" else "y0") for c in ("x_min", "y_min", "x_max", "y_max")})


def image_to_tile_coords(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) - F.col("x0" if c[0] == "x" else "y0") for c in ("x_min", "y_min", "x_max", "y_max")})


def patch_offsets(df: DataFrame, columns: int, tile: int) -> DataFrame:
    """x0, y0 of a patch from its index in a row-major grid."""
    return df.withColumns({"x0": (F.col("patch") % columns) * tile, "y0": F.expr(f"patch div {columns}").cast("int") * tile})
