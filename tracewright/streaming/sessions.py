"""Gap sessions over a stream of events, by event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.scratch import shared_folder

GAP = "30 minutes"


def session_counts(events: DataFrame, gap: str = GAP, late: str = "1 day") -> DataFrame:
    """Sessions of each user (null and negative ones like others) with count and largest value; works on
    streams and tables alike. Rows marked ``closing`` only move the watermark; of a stream they come out
    marked."""
    closing = F.col("closing") if "closing" in events.columns else F.lit(False)
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.coalesce(closing, F.lit(False)).alias("closing"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy("user_id", "closing", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    keep = ["closing"] if e.isStreaming else []  # a filter before the watermark would take the rows that move it
    return (g if e.isStreaming else g.where("NOT closing")).select(*keep, "user_id", F.expr("unix_micros(s.start)").alias("start_us"), F.expr("unix_micros(s.end)").alias("end_us"), "n", "peak")


def streamed_sessions(spark: SparkSession, folder: str, out: str, gap: str = GAP) -> DataFrame:
    """Run the sessions over the Parquet files of ``folder`` as a stream into ``out`` until all are read.

    Sessions leave when the watermark passes them, so a last row of a far later time closes the rest:
    the input ends with rows marked ``closing``, which make no session.
    """
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)
    q = session_counts(stream, gap).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).where("NOT closing").drop("closing")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, copied into a folder of files with closing rows, as a finished stream."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value", F.lit(False).alias("closing"))
    e.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    for year in (2098, 2099):
        end = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.expr(f"timestamp_ntz'{year}-01-01 00:00:00'").alias("ts"), F.lit(0.0).alias("value"), F.lit(True).alias("closing"))
        end.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in e.schema.fields]).write.mode("append").parquet(f"{base}/in")
    return streamed_sessions(spark, f"{base}/in", f"{base}/out")


SESSIONS_SQL = """
WITH s AS (SELECT *, CASE WHEN epoch_us(CAST(ts AS TIMESTAMP)) - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(epoch_us(CAST(ts AS TIMESTAMP))) AS start_us, max(epoch_us(CAST(ts AS TIMESTAMP))) + 1800000000 AS end_us, count(*) AS n, max(value) AS peak FROM g GROUP BY user_id, k
"""
