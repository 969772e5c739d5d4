"""Box tables derived from the test tables by SQL that Spark and other engines run alike.

``fixture(spark, sf_dir, name)`` gives a table as a DataFrame; ``with_tables(name, ...)`` gives the same
SQL as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlake.sources.shared import folder_bytes, written, written_in_buckets

BASE = ("orders", "lineitem", "events")
_WRITTEN = ("fx_base", "fx_det", "fx_gt", "fx_crowd_det", "fx_crowd_gt")
#: Tables of images' rows that are written in buckets by image_id, and the bytes of lineitem to a bucket.
_BY_IMAGE = ("fx_images", "fx_base", "fx_det", "fx_gt")
_BUCKET = 16 << 20

TABLES = {
    "fx_label_map": """
SELECT CAST(id AS INT) AS category_id, name AS category_name
FROM (VALUES (0,'buffalo'),(1,'impala'),(2,'nyala'),(3,'nyala(m)'),(4,'roan'),(5,'sable')) AS t(id, name)""",
    "fx_images": """
SELECT o_orderkey AS image_id,
  concat('camp', CAST(o_custkey % 8 AS STRING), '/images/IMG_', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.jpg') AS file_name,
  concat('camp', CAST(o_custkey % 8 AS STRING), '/images') AS image_dir,
  CASE WHEN o_orderkey % 3 = 0 THEN 2000 ELSE 4000 END AS width,
  CASE WHEN o_orderkey % 3 = 0 THEN 2000 ELSE 3000 END AS height,
  CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'val' ELSE 'test' END AS split
FROM orders""",
    "fx_base": """
SELECT l.l_orderkey AS image_id, i.file_name, i.width, i.height,
  CAST(l.l_partkey % 6 AS INT) AS category_id,
  CAST((l.l_partkey * 7919 + l.l_linenumber * 613 + l.l_suppkey * 31) % (i.width - 240) AS INT) AS bl,
  CAST((l.l_partkey * 104729 + l.l_linenumber * 389 + l.l_suppkey * 57) % (i.height - 240) AS INT) AS bt,
  CAST(40 + (l.l_suppkey * 37 + l.l_linenumber * 11) % 160 AS INT) AS bw,
  CAST(40 + (l.l_suppkey * 53 + l.l_linenumber * 29) % 160 AS INT) AS bh,
  CAST(l.l_orderkey * 100 + row_number() OVER (PARTITION BY l.l_orderkey
    ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate) AS BIGINT) AS rn
FROM lineitem l JOIN fx_images i ON l.l_orderkey = i.image_id""",
    "fx_gt": """
SELECT rn AS annotation_id, image_id, file_name, width, height, category_id,
  CASE WHEN rn % 37 = 1 THEN -15 ELSE bl END AS x_min, bt AS y_min, bl + bw AS x_max, bt + bh AS y_max
FROM fx_base WHERE image_id % 7 <> 0""",
    "fx_det": """
SELECT rn * 3 AS det_id, image_id, file_name, width, height,
  CAST(CASE WHEN rn % 13 = 0 THEN (category_id + 1) % 6 ELSE category_id END AS INT) AS category_id,
  CASE WHEN rn % 37 = 1 THEN -12 ELSE bl + CAST((rn * 7) % 41 AS INT) - 20 END AS x_min,
  bt + CAST((rn * 11) % 41 AS INT) - 20 AS y_min,
  bl + CAST((rn * 7) % 41 AS INT) - 20 + bw + CAST(rn % 9 AS INT) AS x_max,
  bt + CAST((rn * 11) % 41 AS INT) - 20 + bh + CAST(rn % 7 AS INT) AS y_max,
  (5 + (rn * 31) % 95) / 100 AS score
FROM fx_base WHERE rn % 5 <> 0 AND image_id % 11 <> 3
UNION ALL
SELECT rn * 3 + 1, image_id, file_name, width, height, CAST((category_id + 2) % 6 AS INT),
  CAST((bl * 3 + 500) % (width - 240) AS INT), CAST((bt * 5 + 700) % (height - 240) AS INT),
  CAST((bl * 3 + 500) % (width - 240) AS INT) + bw, CAST((bt * 5 + 700) % (height - 240) AS INT) + bh,
  (5 + (rn * 17) % 60) / 100
FROM fx_base WHERE rn % 4 = 0 AND image_id % 11 <> 3
UNION ALL
SELECT rn * 3 + 2, image_id, file_name, width, height, category_id,
  bl + 4, bt + 3, bl + 4 + bw, bt + 3 + bh, (5 + (rn * 13) % 90) / 100
FROM fx_base WHERE rn % 6 = 1 AND image_id % 11 <> 3""",
    "fx_crowd_gt": """
SELECT annotation_id, image_id % 40 AS image_id, concat('crowd_', CAST(image_id % 40 AS STRING)) AS file_name, category_id, x_min, y_min, x_max, y_max
FROM fx_gt""",
    "fx_crowd_det": """
SELECT det_id, image_id % 40 AS image_id, concat('crowd_', CAST(image_id % 40 AS STRING)) AS file_name, category_id, x_min, y_min, x_max, y_max, score
FROM fx_det""",
    "fx_yolo": """
SELECT annotation_id, image_id, file_name, category_id,
  CAST(x_min + x_max AS DOUBLE) / 2 / width AS x, CAST(y_min + y_max AS DOUBLE) / 2 / height AS y,
  CAST(x_max - x_min AS DOUBLE) / width AS w, CAST(y_max - y_min AS DOUBLE) / height AS h
FROM fx_gt""",
    "fx_meta": """
SELECT image_id, file_name, width AS exif_width, height AS exif_height,
  CASE WHEN image_id % 5 = 0 THEN 'UnknownCam' ELSE 'ZenmuseP1' END AS camera_model,
  CAST(35 AS DOUBLE) AS focal_mm,
  CASE WHEN image_id % 17 = 0 THEN NULL ELSE 24 END AS lat_deg,
  CAST(image_id % 60 AS INT) AS lat_min, CAST((image_id * 13) % 6000 AS DOUBLE) / 100 AS lat_sec, 'S' AS lat_ref,
  CASE WHEN image_id % 17 = 0 THEN NULL ELSE 31 END AS lon_deg,
  CAST((image_id * 7) % 60 AS INT) AS lon_min, CAST((image_id * 29) % 6000 AS DOUBLE) / 100 AS lon_sec, 'E' AS lon_ref,
  CAST(300 + image_id % 200 AS DOUBLE) AS altitude_m, CAST(image_id % 4 AS INT) AS altitude_ref
FROM fx_images""",
    "fx_task_results": """
SELECT event_id AS result_id, CAST(floor(event_id / 4) AS BIGINT) AS task_id, CAST(floor(event_id / 4) % 5 AS INT) AS project_id,
  user_id AS annotator_id, event_type AS label, ts
FROM events""",
    "fx_polygons": """
SELECT g.annotation_id AS polygon_id, g.image_id, g.width, g.height, v.k AS vertex_no,
  CAST(CASE v.k WHEN 0 THEN g.x_min WHEN 1 THEN g.x_max WHEN 2 THEN g.x_max ELSE g.x_min END AS DOUBLE) + 0.25e0 - CASE WHEN g.image_id % 4 = 0 THEN 300 ELSE 0 END AS px,
  CAST(CASE v.k WHEN 0 THEN g.y_min WHEN 1 THEN g.y_min WHEN 2 THEN g.y_max ELSE g.y_max END AS DOUBLE) + 0.75e0 AS py
FROM fx_gt g CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    """The tables and those they are made from, in order."""
    wanted = set(names)
    for name in reversed(TABLES):
        if name in wanted:
            wanted |= {other for other in TABLES if other != name and other in TABLES[name]}
    return [name for name in TABLES if name in wanted]


def with_tables(*names: str, materialized: bool = False, recursive: bool = False) -> str:
    """``WITH name AS (...), ...`` for the tables and all they need."""
    how = " AS MATERIALIZED (" if materialized else " AS ("
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n}{how}{TABLES[n]})" for n in _needed(names))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures(spark, sf_dir, name)[0]


#: Tables that ``prepare`` has written, by session, folder and name.
_PREPARED: dict[tuple[int, str, str], DataFrame] = {}


def prepare(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Writes the tables once for this session; queries on them then read what is written, and time is theirs alone."""
    for name, table in zip(names, fixtures(spark, sf_dir, *names), strict=True):
        _PREPARED[id(spark), sf_dir, name] = written(table)


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The tables as DataFrames. What several are made from is written once, and so are tables that operators read
    more than once, so that plans are those of the operators. Rows of images are dealt out by image once, when lineitem is; tables
    keep them in buckets of bounded size, whatever the number of shuffle partitions."""
    if all((id(spark), sf_dir, name) in _PREPARED for name in names):
        return [_PREPARED[id(spark), sf_dir, name] for name in names]
    base = f"parquet.`{sf_dir}/"
    made: dict[str, str] = {}

    def build(name: str) -> DataFrame:
        sql = f"WITH {', '.join(f'{n} AS (SELECT * FROM {p})' for n, p in made.items())} {TABLES[name]}" if made else TABLES[name]
        for table in BASE:
            sql = sql.replace(f"FROM {table}", f"FROM {base}{table}.parquet`")
        return spark.sql(sql)

    out: dict[str, DataFrame] = {}
    needed = _needed(names)
    buckets = 0
    for name in needed:
        out[name] = build(name)
        if name in _WRITTEN or any(name in TABLES[other] for other in needed if other != name):
            if name in _BY_IMAGE and "fx_base" in needed:
                buckets = buckets or max(spark.sparkContext.defaultParallelism, -(-folder_bytes(spark, f"{sf_dir}/lineitem.parquet") // _BUCKET))
                dealt = out[name].repartition(buckets, "image_id") if name == "fx_images" else out[name]  # the others come by image
                out[name] = written_in_buckets(dealt, "image_id", buckets)
                made[name] = out[name].table
            else:
                out[name] = written(out[name])
                made[name] = f"parquet.`{out[name].inputFiles()[0].rpartition('/')[0]}`"
    return [out[name] for name in names]
