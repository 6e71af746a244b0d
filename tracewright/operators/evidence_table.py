"""Evidence kept between runs: an append-only table of operations in versions, with snapshots.

A put or a clearing appends one version, a folder of Parquet files that counts once its job has committed it.
Reading lays the versions after the newest snapshot over it; ``compact`` writes a new one. There is one
writer at a time; readers see whole versions only, and an earlier one by ``version``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "video_id string, stage_id string, payload string, op string, version long"


class EvidenceTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, kind: str) -> list[int]:
        """Committed versions of ``log`` or ``snapshot``, ascending."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = [s.getPath() for s in fs.listStatus(base)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self) -> int:
        """The newest version, 0 if nothing was ever put."""
        return max([0, *self._versions("log"), *self._versions("snapshot")])

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/version={v}" for v in versions]
        return self.spark.read.schema(COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], COLUMNS)

    def load(self, operations: DataFrame) -> int:
        """Append a log of operations that brings its own versions along, as one version."""
        version = self.version() + 1
        operations.select("video_id", "stage_id", "payload", "op", "version").write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        return version

    def _append(self, rows: DataFrame) -> int:
        version = self.version() + 1
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")  # over what a failed job left
        return version

    def put(self, evidence: DataFrame) -> int:
        """Append ``video_id, stage_id, payload``; of several payloads for one stage the largest stays. Rows
        without video or stage are none. Returns the version."""
        e = evidence.select(F.col("video_id").cast("string").alias("video_id"), F.col("stage_id").cast("string").alias("stage_id"), F.col("payload").cast("string").alias("payload"))
        e = e.where("video_id IS NOT NULL AND stage_id IS NOT NULL").groupBy("video_id", "stage_id").agg(F.max("payload").alias("payload"))
        return self._append(e.withColumn("op", F.lit("put")))

    def clear(self, videos: DataFrame | None = None) -> int:
        """Forget the videos of column ``video_id``, or all."""
        rows = self.spark.range(1).select(F.lit(None).cast("string").alias("video_id")) if videos is None else videos.select(F.col("video_id").cast("string").alias("video_id")).where("video_id IS NOT NULL").distinct()
        null = F.lit(None).cast("string")
        return self._append(rows.select("video_id", null.alias("stage_id"), null.alias("payload"), F.lit("clear_all" if videos is None else "clear").alias("op")))

    def operations(self, version: int | None = None) -> DataFrame:
        """The newest snapshot and what came after it, up to ``version``."""
        upto = self.version() if version is None else version
        bases = [v for v in self._versions("snapshot") if v <= upto]
        base = bases[-1] if bases else 0
        log = self._read("log", [v for v in self._versions("log") if base < v <= upto])
        return self._read("snapshot", bases[-1:]).unionByName(log)

    def get_all(self, version: int | None = None) -> DataFrame:
        """``video_id, stage_id, payload, version`` of everything held."""
        return held(self.operations(version))

    def get(self, keys: DataFrame) -> DataFrame:
        """``keys`` (``video_id, stage_id``) with their payload, null where there is none."""
        return keys.join(self.get_all().select("video_id", "stage_id", "payload"), ["video_id", "stage_id"], "left")

    def has(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``has``."""
        mark = self.get_all().select("video_id", "stage_id", F.lit(True).alias("has"))
        return keys.join(mark, ["video_id", "stage_id"], "left").withColumn("has", F.coalesce("has", F.lit(False)))

    def compact(self) -> int:
        """Write what is held as a snapshot of the newest version; later reads start from it."""
        version = self.version()
        self.get_all().withColumn("op", F.lit("put")).select("video_id", "stage_id", "payload", "op", "version").write.mode("overwrite").parquet(f"{self.path}/snapshot/version={version}")
        return version


def held(operations: DataFrame) -> DataFrame:
    """``video_id, stage_id, payload, version``: the last payload put for each stage, if neither its video nor
    everything has been cleared since. ``operations`` have ``op`` and an order, ``version``."""
    cleared = operations.where("op = 'clear'").groupBy("video_id").agg(F.max("version").alias("cleared"))
    everything = operations.where("op = 'clear_all'").agg(F.max("version")).scalar()
    last = operations.where("op = 'put'").groupBy("video_id", "stage_id").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))
    j = last.join(cleared, "video_id", "left").where(F.col("version") > F.coalesce("cleared", F.lit(-1)))
    return j.where(F.col("version") > F.coalesce(everything, F.lit(-1))).select("video_id", "stage_id", "payload", "version")
