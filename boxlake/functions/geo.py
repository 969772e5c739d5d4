"""Positions on the map: angles, ground resolution, and pixels to latitude and longitude by transverse
Mercator series (Snyder 1987, WGS 84) in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 and UTM; sensor heights in mm by camera; altitude references.
A, E2, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 0.00669438, 0.9996, 500000.0, 10000000.0
EP2 = E2 / (1 - E2)
SENSOR_HEIGHTS_MM = {"ZenmuseP1": 24.0}
ALTITUDE_REFERENCES = {0: "Above sea level", 1: "Below sea level"}
FLIGHT_HEIGHT_M, DEFAULT_GSD_M = 180.0, 0.026


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Signed degrees; null if any part is."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(reference.isin("S", "W"), -value).when(reference.isin("N", "E"), value)


def altitude_reference(code: Column) -> Column:
    pairs = [F.lit(x) for kv in ALTITUDE_REFERENCES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit("Unknown"))


def ground_sample_distance(camera: Column, focal_mm: Column, image_height: Column, flight_height_m: float = FLIGHT_HEIGHT_M) -> Column:
    """cm per pixel, rounded to 3; null for cameras that aren't known."""
    sensor = F.element_at(F.create_map(*(F.lit(x) for kv in SENSOR_HEIGHTS_MM.items() for x in kv)), camera)
    return F.round(F.try_divide(F.lit(flight_height_m * 100) * (sensor / 10), (focal_mm / 10) * image_height), 3)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def _central(zone: Column) -> Column:
    return F.radians((zone - 1) * 6 - 180 + 3)


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; south of the equator with the false northing."""
    phi, dl = F.radians(lat), F.radians(lon) - _central(zone)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = A / F.sqrt(1 - E2 * sin * sin)
    t, c, a = tan * tan, EP2 * cos * cos, cos * dl
    e4, e6 = E2**2, E2**3
    m = A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))
    a2, a3, a4, a5, a6 = a * a, a * a * a, a * a * a * a, a * a * a * a * a, a * a * a * a * a * a
    east = K0 * n * (a + (1 - t + c) * a3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a5 / 120) + FALSE_EAST
    north = K0 * (m + n * tan * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a6 / 720))
    return east, F.when(lat < 0, north + FALSE_NORTH).otherwise(north)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude."""
    x, y = east - FALSE_EAST, F.when(south, north - FALSE_NORTH).otherwise(north)
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = y / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    c, t, w = EP2 * cos * cos, tan * tan, 1 - E2 * sin * sin
    n, r = A / F.sqrt(w), A * (1 - E2) / (w * F.sqrt(w))
    d = x / (n * K0)
    d2, d3, d4, d5, d6 = d * d, d * d * d, d * d * d * d, d * d * d * d * d, d * d * d * d * d * d
    lat = foot - n * tan / r * (d2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * d4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * d6 / 720)
    lon = (d - (1 + 2 * t + c) * d3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * d5 / 120) / cos
    return F.degrees(lat), F.degrees(lon + _central(zone))


def with_positions(meta: DataFrame) -> DataFrame:
    """Adds lat, lon and gsd_cm to decoded image metadata."""
    return meta.withColumns({
        "lat": dms_to_decimal(F.col("lat_deg"), F.col("lat_min"), F.col("lat_sec"), F.col("lat_ref")),
        "lon": dms_to_decimal(F.col("lon_deg"), F.col("lon_min"), F.col("lon_sec"), F.col("lon_ref")),
        "gsd_cm": ground_sample_distance(F.col("camera_model"), F.col("focal_mm"), F.col("exif_height")),
    })


def pixel_to_latlon(df: DataFrame, x: Column, y: Column, width: str = "exif_width", height: str = "exif_height", prefix: str = "px_") -> DataFrame:
    """Adds <prefix>lat and <prefix>lon of a pixel, the image's centre being at lat, lon. Steps stay in columns of
    their own, so that each expression is computed once; the centre's zone holds for the pixel."""
    gsd = F.coalesce(F.col("gsd_cm") / 100, F.lit(DEFAULT_GSD_M))
    zoned = df.withColumns({"__zone": utm_zone(F.col("lon")), "__gsd": gsd})
    east, north = to_utm(F.col("lat"), F.col("lon"), F.col("__zone"))
    moved = zoned.withColumns({"__east": east + (x - F.col(width) / 2) * F.col("__gsd"), "__north": north + (F.col(height) / 2 - y) * F.col("__gsd")})
    lat, lon = from_utm(F.col("__east"), F.col("__north"), F.col("__zone"), F.col("lat") < 0)
    return moved.withColumns({f"{prefix}lat": lat, f"{prefix}lon": lon}).drop("__zone", "__gsd", "__east", "__north")


def geotag_detections(dets: DataFrame, meta: DataFrame) -> DataFrame:
    """Detections with the place of their box's centre; null where the image has none. Metadata is placed once
    per image and joined, not looked up per box."""
    placed = with_positions(meta).select("image_id", "exif_width", "exif_height", "lat", "lon", "gsd_cm")
    joined = dets.join(placed, "image_id", "left")
    return pixel_to_latlon(joined, (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2)
