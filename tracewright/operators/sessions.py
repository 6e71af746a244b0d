"""Sessions, islands, episodes and rising edges of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], order: str, gap: Column, out: str = "session") -> DataFrame:
    """Number the runs of rows whose steps in ``order`` are at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("long")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(out, F.sum("__new").over(w)).drop("__new")


def islands(df: DataFrame, keys: list[str], flag: Column, order: str = "frame", out: str = "run") -> DataFrame:
    """Rows where ``flag`` holds, numbered by maximal run of neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__pos", F.row_number().over(w).cast("long")).where(flag)
    return marked.withColumn(out, F.col("__pos") - F.row_number().over(w)).drop("__pos")


def broken_runs(df: DataFrame, keys: list[str], valid: Column, order: str, gap: Column, out: str = "run") -> DataFrame:
    """Valid rows numbered by run; a run ends at an invalid row or a step over ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    stop = (~valid).cast("long") + F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("__stop", stop).withColumn(out, F.sum("__stop").over(w)).where(valid).drop("__stop")


def grid_step(df: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """``grid_step``: the median step, truncated, 1 at least."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("__d", (F.col(order) - F.lag(order).over(w)).cast("double"))
    return steps.groupBy(*keys).agg(F.greatest(F.floor(F.coalesce(F.median("__d"), F.lit(1.0))).cast("long"), F.lit(1).cast("long")).alias("grid_step"))


def rising_edges(touching: DataFrame, frames: DataFrame, video: str, pair: list[str]) -> DataFrame:
    """First rows of runs over *observed* frames: touching now, not at the frame observed before."""
    rank = frames.select(video, "frame").distinct().withColumn("__r", F.row_number().over(Window.partitionBy(video).orderBy("frame")))
    w = Window.partitionBy(video, *pair).orderBy("frame")
    r = touching.join(rank, [video, "frame"]).withColumn("__p", F.lag("__r").over(w))
    return r.where(F.col("__p").isNull() | (F.col("__p") != F.col("__r") - 1)).drop("__r", "__p")


def episodes(df: DataFrame, keys: list[str], value: str, gap: Column) -> DataFrame:
    """``f_start, f_end, n, peak, peak_frame`` of runs of over-threshold rows (ties: first frame)."""
    s = sessionize(df, keys, "frame", gap)
    return s.groupBy(*keys, "session").agg(
        F.min("frame").alias("f_start"), F.max("frame").alias("f_end"), F.count("*").alias("n"), F.max(value).alias("peak"),
        F.max_by("frame", F.struct(F.col(value), -F.col("frame"))).alias("peak_frame"),
    ).drop("session")


def chain_dedupe(df: DataFrame, keys: list[str], window: int) -> DataFrame:
    """In order of frame, a row within ``window`` of the row kept last stands for it if its score is
    larger (the kept frame moves with it), else it goes; ties in frame go by score.

    Every step depends on the one before, but no chain crosses a step over ``window`` between neighbours:
    the rows are cut there, and only the short pieces between are folded. A fold's state is the row kept
    last; those before it are set aside once.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), F.col("score").cast("double").alias("score"))))
    kind = "struct<last:struct<frame:bigint,score:double>,done:array<struct<frame:bigint,score:double>>>"
    start = F.from_json(F.lit('{"done":[]}'), kind)

    def step(a: Column, row: Column) -> Column:
        last = a["last"]
        near = row["frame"] - last["frame"] <= window
        moved = F.when(last.isNull() | (near & (row["score"] > last["score"])) | ~near, row).otherwise(last)
        done = F.when(last.isNull() | near, a["done"]).otherwise(F.array_append(a["done"], last))
        return F.struct(moved.alias("last"), done.alias("done"))

    pieces = sessionize(df, keys, "frame", F.lit(window), "__piece")
    folded = pieces.groupBy(*keys, "__piece").agg(rows.alias("__rows"))
    return folded.select(*keys, F.inline(F.aggregate("__rows", start, step, lambda a: F.array_append(a["done"], a["last"]))))
