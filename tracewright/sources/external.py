"""Schemas of what external producers hand in, and the hook to run one.

Decoding, tracking, segmentation, embedding and language models stay outside the engine. A producer is
a function over batches of ``frames`` rows; it runs through ``mapInPandas`` and must give the columns of
its schema. Without a producer a table is empty, never made up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "frames": "video_id string, frame_idx long, t double, width int, height int, image binary",
    "observations": "video_id string, source string, track_id long, label string, named boolean, frame long, t double, x double, y double, box struct<x0:double,y0:double,x1:double,y1:double>, area double, conf double",
    "descriptors": "video_id string, track_id long, frame long, t double, model string, z array<float>",
    "flow_stats": "video_id string, frame long, t double, mean_mag double, consistency double, vx_med double, vy_med double, resid double, inlier_ratio double, zone array<double>",
    "region_flow": "video_id string, i long, frame long, t double, speed double, vec_x double, vec_y double, div_norm double, jump_norm double",
    "signals": "video_id string, track_id long, signal_type string, frame long, t double, score double",
    "answers": "video_id string, event_type string, p double",
    "tests": "run_id long, stage string, test string, status string, severity double, excluded boolean",
    "replies": "video_id string, stage_id string, raw string",
}

Producer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def produce(frames: DataFrame, name: str, producer: Producer | None) -> DataFrame:
    if producer is None:
        return empty(frames.sparkSession, name)
    return frames.mapInPandas(producer, SCHEMAS[name])


def video_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Paths and sizes of the files with an allowed extension, without their content."""
    from pyspark.sql import functions as F

    from tracewright.functions.parsing import allowed_extension

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.where(allowed_extension(F.col("path"), extensions))


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.write.mode("overwrite").json(path)
