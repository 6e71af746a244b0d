"""Pair, range and nearest joins. Every one has equality keys (the video, and where frames range far a
block of frames), so none plans as a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def track_pairs(df: DataFrame, keep: list[str], keys: tuple[str, ...] = ("video_id", "frame")) -> DataFrame:
    """Pairs of tracks on common frames, ``track_a < track_b``; kept columns get ``_a`` and ``_b``.

    A frame's tracks meet in one grouped pass (``df`` is computed and shuffled once, not for each side of
    a self-join); every track then unfolds its later partners.
    """
    side = lambda r, s: [r["track_id"].alias(f"track_{s}"), *[r[c].alias(f"{c}_{s}") for c in keep]]
    frames = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("track_id", *keep))).alias("__m")).where(F.size("__m") > 1)
    each = frames.select(*keys, "__m", F.posexplode("__m").alias("__i", "__a"))
    later = F.transform(F.slice("__m", F.col("__i") + 2, F.size("__m")), lambda b: F.struct(*side(b, "b")))
    return each.select(*keys, *side(F.col("__a"), "a"), F.inline(later)).where("track_a < track_b")


def in_blocks(df: DataFrame, low, high, size: int, out: str = "__block") -> DataFrame:
    """Each row once for every block of ``size`` that its range [low, high] touches."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))


def near_events(points: DataFrame, events: DataFrame, keys: list[str], slack: int, how: str, block: int = 256) -> DataFrame:
    """Points (``frame``) with (``left_semi``) or without (``left_anti``) an event whose range
    ``f_start - slack .. f_end + slack`` holds them."""
    near = flag_near_events(points, events, keys, slack, "__near", block)
    return near.where("__near" if how == "left_semi" else "NOT __near").drop("__near")


def flag_near_events(points: DataFrame, events: DataFrame, keys: list[str], slack: int, out: str, block: int = 256) -> DataFrame:
    """Points with a flag: whether an event's range ``f_start - slack .. f_end + slack`` holds them.

    The ranges of a block are gathered first, so every point meets one row and the flag answers both the
    semi and the anti join.
    """
    ranges = in_blocks(events.select(*keys, (F.col("f_start") - slack).alias("lo"), (F.col("f_end") + slack).alias("hi")), F.col("lo"), F.col("hi"), block)
    ranges = ranges.groupBy(*keys, "__block").agg(F.collect_set(F.struct("lo", "hi")).alias("__ranges"))
    p = points.withColumn("__block", F.floor(F.col("frame") / block).cast("long")).join(ranges, [*keys, "__block"], "left")
    held = F.exists("__ranges", lambda r: F.col("frame").between(r["lo"], r["hi"]))
    return p.withColumn(out, F.coalesce(held, F.lit(False))).drop("__block", "__ranges")


def nearest(points: DataFrame, others: DataFrame, keys: list[str], window: int, id_col: str) -> DataFrame:
    """For each point the nearest other frame at most ``window`` away (ties: the earlier one), as
    ``near_frame``; null if none. ``id_col`` tells points apart; points equal in all columns are one."""
    o = in_blocks(others.select(*keys, F.col("frame").alias("__o")), F.col("__o") - window, F.col("__o") + window, max(window, 1))
    p = points.withColumn("__block", F.floor(F.col("frame") / max(window, 1)).cast("long"))
    away = F.abs(F.col("__o") - F.col("frame"))
    rank = F.when(away <= window, away * 2 + (F.col("__o") > F.col("frame")).cast("long"))
    # Grouped with its block, a point stays in the partition where it met the others.
    return p.join(o, [*keys, "__block"], "left").groupBy("__block", *points.columns).agg(F.min_by("__o", rank).alias("near_frame")).drop("__block")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first``, and of ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(first.columns))
