"""The evidence store as a table, its retention, and the order in which missing producers run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each stage reads from the bus.
DEPENDS = {
    "object_tracker": [], "trajectory_extractor": ["object_tracker"], "event_localizer": [], "physics_hypothesis_generator": ["trajectory_extractor", "event_localizer", "object_tracker"],
    "gravity": ["trajectory_extractor", "object_tracker"], "collision": ["object_tracker"], "momentum": ["object_tracker"], "friction": ["object_tracker"], "fluid": ["object_tracker"],
    "deformation": ["object_tracker"], "causality": ["trajectory_extractor"],
}


def latest(store: DataFrame) -> DataFrame:
    """The payload put last for every (video, stage); ``store`` has ``video_id, stage_id, seq, payload``."""
    return store.groupBy("video_id", "stage_id").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def retained(store: DataFrame, videos: int = 16) -> DataFrame:
    """Rows of the ``videos`` videos put last; reading does not renew a video."""
    keep = store.groupBy("video_id").agg(F.max("seq").alias("s")).orderBy(F.desc("s"), "video_id").limit(videos)
    return store.join(F.broadcast(keep.select("video_id")), "video_id", "left_semi")


def plan(stage: str, have: set[str], most: int = 3) -> list[str]:
    """Missing producers of a stage, dependencies first, ``most`` at most."""
    out: list[str] = []

    def visit(s: str) -> None:
        for d in DEPENDS.get(s, []):
            if d not in have and d not in out:
                visit(d)
                out.append(d)

    visit(stage)
    return out[:most]


def history(store: DataFrame) -> DataFrame:
    """Every put with its place from the latest (1)."""
    w = Window.partitionBy("video_id", "stage_id").orderBy(F.desc("seq"))
    return store.withColumn("place", F.row_number().over(w))
