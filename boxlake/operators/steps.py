"""Batch scoring with a caller's function, and named steps over a shared context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators import matching, sampling, selection
from boxlake.operators.checks import check_parameters
from boxlake.sources import writers
from boxlake.sources.shared import buckets_of, written, written_in_buckets

PREDICTED = "image_id bigint, file_name string, x_min double, y_min double, x_max double, y_max double, score double, category_id int"


def score_images(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str = PREDICTED, batch: int = 256) -> DataFrame:
    """Boxes that a caller's predictor finds, in Arrow batches; load() gives the predictor, once per task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for part in parts:
            for at in range(0, len(part), batch):
                yield predict(part.iloc[at : at + batch])

    return images.mapInPandas(run, schema)


class Pipeline:
    """Steps run in order; each takes the context (names to DataFrames and values) and gives what it adds."""

    def __init__(self, steps: list[Callable[[dict[str, Any]], dict[str, Any] | None]]):
        self.steps = steps

    def run(self, context: dict[str, Any] | None = None) -> dict[str, Any]:
        context = dict(context or {})
        for step in self.steps:
            context |= step(context) or {}
        return context


def hard_negative_cycle(images: DataFrame, gts: DataFrame, score: Callable[[DataFrame], DataFrame], ratio: float = 20.0, **limits: float) -> DataFrame:
    """Samples many empties with the positives, scores those images, and gives the hard ones."""
    check_parameters(ratio=ratio)
    sampled = sampling.sample_pos_neg(images, gts, ratio)
    table = selection.image_table(score(sampled), gts.join(sampled.select("image_id"), "image_id", "left_semi"))
    return selection.hard_samples(table, **limits)


@dataclass(frozen=True)
class CycleSettings:
    """What a round of hard-negative learning takes from the training settings."""

    ratio: float = 20.0
    seed: int = sampling.SEED
    fp_tp: float = 0.2
    fn_tp: float = 0.2
    max_map: float = 0.3
    score: float = 0.7
    max_uncertainty: float = 4.0
    root: str = ""


def hard_negative_round(images: DataFrame, gts: DataFrame, manifest: DataFrame, score: Callable[[DataFrame], DataFrame], settings: CycleSettings = CycleSettings()) -> dict[str, DataFrame]:
    """A round to its end, in steps that each write what they give: sampled (images with many empties), detections (what
    score finds in them), hard (the samples chosen), paths (their list) and manifest (whose train split is that list)."""
    limits = {k: getattr(settings, k) for k in ("fp_tp", "fn_tp", "max_map", "score", "max_uncertainty")}

    def sample(c: dict) -> dict:
        return {"sampled": written(sampling.sample_pos_neg(images, gts, settings.ratio, settings.seed))}

    def detect(c: dict) -> dict:
        found, n = score(c["sampled"]), buckets_of(gts)
        return {"detections": written_in_buckets(found.repartition(n, "image_id"), "image_id", n) if n else written(found)}

    def choose(c: dict) -> dict:
        truth = gts.join(c["sampled"].select("image_id"), "image_id", "left_semi")
        return {"hard": written(selection.hard_samples(selection.image_table(c["detections"], truth), **limits), together=True)}

    def subset(c: dict) -> dict:
        root = settings.root.rstrip("/")
        hard = c["hard"].withColumn("file_name", F.concat(F.lit(f"{root}/"), "file_name")) if root else c["hard"]
        return dict(zip(("paths", "manifest"), selection.training_subset(hard, manifest), strict=True))

    return Pipeline([sample, detect, choose, subset]).run()


def write_hard_negative_round(found: dict[str, DataFrame], folder: str, root: str, names: dict[int, str]) -> None:
    """The round's path list under folder/images, and folder/manifest whose train split names it; the other splits are those of
    the manifest, which are a few folders."""
    writers.write_path_list(found["paths"], f"{folder}/images", "path")
    dirs: dict[str, list[str]] = {"train": [f"{folder}/images"]}
    for r in found["manifest"].filter("split <> 'train'").orderBy("split", "dir").collect():
        dirs.setdefault(r.split, []).append(r.dir)
    writers.write_manifest(found["paths"].sparkSession, f"{folder}/manifest", root, dirs, names)


def performance_report(dets: DataFrame, gts: DataFrame) -> DataFrame:
    """The evaluation table without arrays, ready for a CSV sink."""
    return selection.image_table(dets, gts).drop("all_scores")


def classification_report(dets: DataFrame, gts: DataFrame, n_classes: int, threshold: float = 0.5, top: int = 10) -> DataFrame:
    """Scores of the classes with most ground truth, by one-to-one matches."""
    scores = matching.class_scores(matching.confusion_one_to_one(dets, gts, n_classes, threshold=threshold), n_classes)
    counts = gts.groupBy("category_id").count().withColumnRenamed("category_id", "class").withColumnRenamed("count", "support")
    return scores.join(counts, "class").orderBy(counts["support"].desc(), "class").limit(top)


def register_tile_function(spark: SparkSession, name: str = "tiles") -> None:
    """A SQL table function (width, height, tile, overlap) of tile corners x0, y0, x1, y1, as ``tile_grid`` has them. It is SQL
    itself, so queries that use it are planned as one."""
    step = "(tile - CAST(tile * overlap AS INT))"
    start = lambda k, side: f"greatest(least({k} * {step}, {side} - tile), 0)"
    last = lambda side: f"greatest(CAST(ceil(({side} - tile) / {step}) AS INT), 0)"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(width INT, height INT, tile INT, overlap DOUBLE) RETURNS TABLE (x0 INT, y0 INT, x1 INT, y1 INT)
RETURN SELECT x0, y0, least(x0 + tile, width), least(y0 + tile, height) FROM inline(flatten(
  transform(sequence(0, {last('width')}), ix -> transform(sequence(0, {last('height')}), iy ->
    named_struct('x0', {start('ix', 'width')}, 'y0', {start('iy', 'height')}))))) AS t(x0, y0)""")
