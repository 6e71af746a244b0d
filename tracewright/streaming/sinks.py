"""Events as JSON lines, progress of a stream, and what a run cost."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: What a tier of cost stands for.
TIERS = {"cheap": "CPU-light, seconds", "medium": "GPU model inference", "expensive": "heavy multi-model GPU", "output": "aggregation only"}


def json_batches(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream as JSON lines, a folder a batch.

    A batch's folder is named by its id and written over if the batch is tried again, so a run that was
    killed between writing and committing writes each event once after it resumes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id:012d}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all batches whose writing was finished, with their ``batch``."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(base) else []
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(schema).option("basePath", path).json(done).withColumn("batch", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("long"))


@dataclass
class Progress(StreamingQueryListener):
    """Events of a stream's progress: ``progress`` with ``done`` and ``total`` rows after each batch, then
    ``done``, or ``error`` with its text. Only queries named ``name`` are listened to."""

    name: str
    total: int
    emit: Callable[[dict], None]
    done: int = 0
    ids: set = field(default_factory=set)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.numInputRows:
            self.done += event.progress.numInputRows
            self.emit({"type": "progress", "done": self.done, "total": self.total})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ids:
            self.emit({"type": "error", "text": event.exception} if event.exception else {"type": "done", "total": self.total})


def run_with_costs(spark: SparkSession, operator, source, path: str, settings: dict | None = None, clock: Callable[[], float] = time.perf_counter) -> list[dict]:
    """Run an operator, write its rows as JSON lines under ``path``, and return (and write) the run's events.

    The cost row ``timing`` (milliseconds, rows read and written, tier) comes before ``done``; a run that
    fails ends in ``error`` instead and leaves no ``done``. Rows written are observed in the run itself.
    """
    began, events = clock(), [{"type": "log", "level": "info", "text": f"running {operator.id}"}]
    try:
        rows_in = sum(source.table(name).count() for name in operator.reads if name in source) if hasattr(source, "table") else spark.read.parquet(f"{source}/events.parquet").count()
        seen = Observation(f"run-{uuid.uuid4().hex}")
        operator.run(spark, source, settings).observe(seen, F.count(F.lit(1)).alias("rows_out")).write.mode("overwrite").json(f"{path}/result")
        ms = round((clock() - began) * 1000)
        events += [
            {"type": "timing", "duration_ms": ms, "rows_in": rows_in, "rows_out": seen.get["rows_out"], "badge": operator.tier},
            {"type": "metric", "label": "Runtime", "value": f"{ms / 1000:.1f}s", "sub": "wall clock, whole test"},
            {"type": "metric", "label": "Cost tier", "value": operator.tier, "sub": TIERS.get(operator.tier, "")},
            {"type": "done"},
        ]
    except Exception as e:
        events.append({"type": "error", "text": str(e)})
    schema = "type string, level string, text string, duration_ms long, rows_in long, rows_out long, badge string, label string, value string, sub string, place long"
    rows = [tuple(e.get(c) for c in ("type", "level", "text", "duration_ms", "rows_in", "rows_out", "badge", "label", "value", "sub")) + (i,) for i, e in enumerate(events)]
    spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("place").drop("place").write.mode("overwrite").json(f"{path}/events")
    return events
