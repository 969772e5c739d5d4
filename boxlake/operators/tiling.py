"""Tiles over images, boxes in tiles, and samples of empty tiles. Boxes reach tiles by computed tile
indexes and an equi-join, never by comparing every box with every tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.operators import sampling
from boxlake.operators.checks import check_parameters
from boxlake.operators.conversions import expand_box
from boxlake.sources.shared import buckets_of, written, written_in_buckets

TILE_KEYS = ("image_id", "ix", "iy")


def check_tiles(tile: int, overlap: float) -> int:
    check_parameters(tile=tile, overlap=overlap)
    return tile - int(tile * overlap)


def _count(side: Column, tile: int, step: int) -> Column:
    """Tiles along a side: as many steps as it takes to reach the end."""
    return F.greatest(F.ceil((side - tile) / step), F.lit(0)).cast("int") + 1


def _from(index: Column, side: Column, tile: int, step: int) -> Column:
    """Start of a tile; the last is pulled back inside."""
    return F.greatest(F.least(index * step, side - tile), F.lit(0)).cast("int")


def tile_grid(images: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """image_id, file_name, ix, iy, x0, y0, x1, y1; an image smaller than a tile has one, clipped."""
    step = check_tiles(tile, overlap)
    index = lambda side: F.explode(F.sequence(F.lit(0), _count(F.col(side), tile, step) - 1))
    grid = images.select("image_id", "file_name", "width", "height", index("width").alias("ix")).select("*", index("height").alias("iy"))
    placed = grid.withColumns({"x0": _from(F.col("ix"), F.col("width"), tile, step), "y0": _from(F.col("iy"), F.col("height"), tile, step)})
    return placed.select("image_id", "file_name", "ix", "iy", "x0", "y0", F.least(F.col("x0") + tile, "width").alias("x1"), F.least(F.col("y0") + tile, "height").alias("y1"))


def _touched(low: str, high: str, side: str, tile: int, step: int) -> Column:
    """Indexes of the tiles that a span of an axis may touch. The last tile, pulled back, is always among
    the candidates when the span reaches past its start."""
    last = _count(F.col(side), tile, step) - 1
    first = F.greatest(F.floor((F.col(low) - tile) / step).cast("int") + 1, F.lit(0))
    final = F.least(F.floor(F.col(high) / step).cast("int"), last)
    pulled = _from(last, F.col(side), tile, step) < F.col(high)
    return F.explode(F.sequence(F.least(first, last), F.when(pulled, last).otherwise(final)))


def assign_boxes_to_tiles(boxes: DataFrame, tile: int = 640, overlap: float = 0.2, min_area_ratio: float = 0.8) -> DataFrame:
    """Boxes (with their image's width and height) in every tile that holds at least min_area_ratio of them:
    the tile and x_min, y_min, w, h in the tile, rounded down."""
    step = check_tiles(tile, overlap)
    near = boxes.select("*", _touched("x_min", "x_max", "width", tile, step).alias("ix")).select("*", _touched("y_min", "y_max", "height", tile, step).alias("iy"))
    placed = near.withColumns({"x0": _from(F.col("ix"), F.col("width"), tile, step), "y0": _from(F.col("iy"), F.col("height"), tile, step)})
    placed = placed.withColumns({"x1": F.least(F.col("x0") + tile, "width"), "y1": F.least(F.col("y0") + tile, "height")})
    cut = placed.withColumns({"cx0": F.greatest("x_min", "x0"), "cy0": F.greatest("y_min", "y0"), "cx1": F.least("x_max", "x1"), "cy1": F.least("y_max", "y1")})
    inside = cut.filter("cx1 > cx0 AND cy1 > cy0")
    share = ((F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))).cast("double") / ((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))).cast("double")
    kept = inside.filter(share >= min_area_ratio)
    return kept.select("annotation_id", "image_id", "category_id", "ix", "iy", "x0", "y0", "x1", "y1", F.floor(F.col("cx0") - F.col("x0")).cast("int").alias("x_min"), F.floor(F.col("cy0") - F.col("y0")).cast("int").alias("y_min"), F.floor(F.col("cx1") - F.col("cx0")).cast("int").alias("w"), F.floor(F.col("cy1") - F.col("cy0")).cast("int").alias("h"))


def tiles_with_annotations(images: DataFrame, boxes: DataFrame, tile: int = 640, overlap: float = 0.2, min_area_ratio: float = 0.8) -> DataFrame:
    """All tiles with their boxes; a tile without has nulls. x, y are a box's centre in the tile. Tables that are in buckets by image
    meet where they are, and the tiles are such a table too."""
    found = assign_boxes_to_tiles(boxes, tile, overlap, min_area_ratio).drop("x0", "y0", "x1", "y1")
    out = tile_grid(images, tile, overlap).join(found, list(TILE_KEYS), "full_outer")
    out = out.withColumns({"x": F.col("x_min") + F.col("w") / 2, "y": F.col("y_min") + F.col("h") / 2})
    return written_in_buckets(out, "image_id", n) if (n := buckets_of(images, boxes)) else out


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    """One row for each tile of a file. Tiles of a file that one image has repeat within that image, so they stay where its rows are;
    only those of files that several images have are dealt out by file."""
    corners = ["file_name", "x0", "y0", "x1", "y1"]
    if "image_id" not in tiles.columns:
        return tiles.dropDuplicates(corners)
    owners = tiles.select("image_id", "file_name").distinct().groupBy("file_name").agg(F.count(F.lit(1)).alias("__n"))
    several = written(owners.filter("__n > 1").select(F.col("file_name").alias("__file")))
    if several.isEmpty():
        return tiles.dropDuplicates(["image_id", *corners])
    of = lambda how: tiles.join(several, F.col("file_name").eqNullSafe(F.col("__file")), how)
    return of("left_anti").dropDuplicates(["image_id", *corners]).unionByName(of("left_semi").dropDuplicates(corners))


def sample_tiles(tiles: DataFrame, empty_ratio: float = 1.0, save_all: bool = False, only_empty: bool = False, seed: int = 41) -> DataFrame:
    """Tiles with boxes and min(floor(tiles with boxes * ratio), empty tiles) of the empty ones; save_all keeps
    all empties, only_empty gives the sampled empties alone."""
    check_parameters(save_all=save_all, only_empty=only_empty, ratio=empty_ratio)
    if save_all:
        return tiles
    tiles = tiles if buckets_of(tiles) else written(tiles)  # counted, sampled and given out: the boxes are put into tiles once
    full, bare = tiles.filter("annotation_id IS NOT NULL"), tiles.filter("annotation_id IS NULL")
    counts = full.select(*TILE_KEYS).distinct().agg(F.floor(F.count(F.lit(1)) * empty_ratio).alias("n"))
    key = F.concat_ws("_", "file_name", "x0", "y0")
    picked = sampling.lowest_hashes(bare.withColumn("__key", key), counts, "__key", seed).drop("__key")
    return picked if only_empty else full.unionByName(picked)


def ratio_grid(images: DataFrame, ratio_w: float, ratio_h: float, overlap: float = 0.0, margin_w: float = 0.0, margin_h: float = 0.0) -> DataFrame:
    """Tiles whose sides are a share of the image's, within borders from which margins are taken off."""
    def axis(side: str, ratio: float, margin: float) -> tuple[Column, Column]:
        size = F.greatest(F.floor(F.col(side) * ratio).cast("int"), F.lit(1))
        low, high = F.floor(F.col(side) * margin).cast("int"), F.col(side) - F.floor(F.col(side) * margin).cast("int")
        step = F.greatest(size - F.floor(size * overlap).cast("int"), F.lit(1))
        return F.explode(F.sequence(low, F.greatest(low, high - size), step)), size

    (xs, w), (ys, h) = axis("width", ratio_w, margin_w), axis("height", ratio_h, margin_h)
    out = images.select("image_id", "file_name", "width", "height", xs.alias("x0")).select("*", ys.alias("y0"))
    return out.select("image_id", "file_name", "x0", "y0", (F.col("x0") + w).alias("x1"), (F.col("y0") + h).alias("y1"))


def crop_manifest(boxes: DataFrame, folder: str, id_column: str, factor: float = 2.0) -> DataFrame:
    """What to cut from which image: path, x1, y1, x2, y2, folder and crop name; rows of one image stand
    together, so that it is opened once."""
    grown = expand_box(boxes, factor)
    stem = F.regexp_replace(F.regexp_extract("file_name", r"[^/]+$", 0), r"\.[^.]+$", "")
    return grown.select(F.col("file_name").alias("path"), "x1", "y1", "x2", "y2", F.lit(folder).alias("folder"), F.concat(stem, F.lit("-"), F.col(id_column).cast("string"), F.lit(".jpg")).alias("crop_name"))
