"""Derivatives and smoothing of ordered series, as window expressions over one track window."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(*xs: Column) -> Column:
    total = xs[0] * xs[0]
    for x in xs[1:]:
        total = total + x * x
    return F.sqrt(total)


def gradient(y: Column, t: Column, w) -> Column:
    """Second-order derivative on an uneven grid, one-sided at the ends, 0 for a single sample."""
    p, n, hs, hd = F.lag(y).over(w), F.lead(y).over(w), t - F.lag(t).over(w), F.lead(t).over(w) - t
    inner = (hs * hs * n + (hd * hd - hs * hs) * y - hd * hd * p) / (hs * hd * (hs + hd))
    return F.when(p.isNull() & n.isNull(), F.lit(0.0)).when(p.isNull(), (n - y) / hd).when(n.isNull(), (y - p) / hs).otherwise(inner)


def steady_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """``t`` replaced by the place in the series where a series' times do not increase."""
    w, whole = Window.partitionBy(*keys).orderBy("frame"), Window.partitionBy(*keys)
    step = df.withColumn("__d", F.col("t") - F.lag("t").over(w)).withColumn("__n", (F.row_number().over(w) - 1).cast("double"))
    return step.withColumn("t", F.when(F.min("__d").over(whole) <= 0, F.col("__n")).otherwise(F.col("t"))).drop("__d", "__n")


def kinematics(obs: DataFrame, w) -> DataFrame:
    """Adds ``vx, vy, speed, ax, ay, accel, jerk``."""
    t = F.col("t")
    out = obs.withColumns({"vx": gradient(F.col("x"), t, w), "vy": gradient(F.col("y"), t, w)})
    out = out.withColumns({"speed": norm(F.col("vx"), F.col("vy")), "ax": gradient(F.col("vx"), t, w), "ay": gradient(F.col("vy"), t, w)})
    out = out.withColumn("accel", norm(F.col("ax"), F.col("ay")))
    return out.withColumn("jerk", F.abs(gradient(F.col("accel"), t, w)))


def box3(y: Column, w, pad: str = "edge") -> Column:
    """Mean of three; ``edge`` repeats the end samples, ``zero`` pads with zeros."""
    fill = y if pad == "edge" else F.lit(0.0)
    return (F.coalesce(F.lag(y).over(w), fill) + y + F.coalesce(F.lead(y).over(w), fill)) / 3


#: Savitzky-Golay, window 7, degree 2: weights over 42 for the first three places of a series and for
#: the inner ones (the last three mirror the first).
SAVGOL7 = {0: (32, 15, 3, -4, -6, -3, 5), 1: (15, 12, 9, 6, 3, 0, -3), 2: (3, 9, 12, 12, 9, 3, -6), 3: (-4, 6, 12, 14, 12, 6, -4)}


#: The same for window 5, over 35.
SAVGOL5 = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5), 2: (-3, 12, 17, 12, -3)}


def savgol7(y: Column, w, place: Column, size: Column) -> Column:
    """Degree-2 smoothing over seven samples, over five where a series has no more than six; over three it
    changes nothing."""

    def at(weights: tuple[int, ...], first: int, over: int = 42) -> Column:
        total = None
        for k, c in enumerate(weights):
            d = first + k
            v = y if d == 0 else F.lead(y, d).over(w) if d > 0 else F.lag(y, -d).over(w)
            total = c * v if total is None else total + c * v
        return total / over

    out = F.when(size < 5, y)
    for k in range(2):
        out = out.when((size < 7) & (place == k), at(SAVGOL5[k], -k, 35)).when((size < 7) & (place == size - 1 - k), at(SAVGOL5[k][::-1], k - 4, 35))
    out = out.when(size < 7, at(SAVGOL5[2], -2, 35))
    for k in range(3):
        out = out.when(place == k, at(SAVGOL7[k], -k)).when(place == size - 1 - k, at(SAVGOL7[k][::-1], k - 6))
    return out.otherwise(at(SAVGOL7[3], -3))


@cache
def savgol_weights(w: int, place: int, degree: int = 2) -> tuple[float, ...]:
    """Weights of the least-squares polynomial over ``w`` samples at one of their places."""
    at = np.vander(np.arange(w) - place, min(degree, w - 1) + 1, increasing=True).astype(float)
    return tuple(float(x) for x in np.linalg.pinv(at)[0])


def savgol(y: Column, w, place: Column, size: Column, window: int) -> Column:
    """Degree-2 smoothing over ``window`` samples, in a shorter series over the largest odd number that it has;
    at both ends the outermost polynomial goes on. Under three samples, or for such a window, nothing changes.

    The weights are a table by width and place; a row takes its own from it.
    """
    widths = range(3, window + 1, 2)
    if not widths:
        return y
    table = F.array(*[F.array(*[F.lit(x) for x in savgol_weights(k, p)]) for k in widths for p in range(k)])
    most = widths[-1]
    width = F.least(F.lit(most), size - F.when(size % 2 == 0, 1).otherwise(0))
    half = (width - 1) / 2
    own = F.when(place < half, place).when(place >= size - half, width - size + place).otherwise(half).cast("int")
    # Widths 3, 5, .. below this one have (width / 2)**2 - 1 rows before its own.
    row = F.get(table, (half * half - 1).cast("int") + own)
    near = F.collect_list(y).over(w.rowsBetween(1 - most, most - 1))
    first = F.least(place, F.lit(most - 1)).cast("int") - own
    terms = F.zip_with(F.slice(near, first + 1, width.cast("int")), row, lambda a, b: a * b)
    return F.when(size < 3, y).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def boxcar(y: Column, w, size: Column, window: int) -> Column:
    """Mean over ``window`` samples (the largest odd number up to the series' length), end samples repeated."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(y).over(whole), F.last(y).over(whole)
    out = F.when(size < 3, y)
    for k in range(3, window + 1, 2):
        total = None
        for d in range(-(k // 2), k // 2 + 1):
            v = y if d == 0 else F.coalesce(F.lead(y, d).over(w), last) if d > 0 else F.coalesce(F.lag(y, -d).over(w), first)
            total = v if total is None else total + v
        fits = (size >= k) if k + 2 > window else (size >= k) & (size < k + 2)
        out = out.when(fits, total / k)
    return out if window >= 3 else y


def gaussian_weights(window: int) -> list[float]:
    half, sigma = window // 2, max(window / 4.0, 1e-6)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def gaussian(y: Column, w, window: int, keys: list[str]) -> Column:
    """Gaussian smoothing with repeated end samples; sigma is a quarter of the window."""
    half = window // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(y).over(whole), F.last(y).over(whole)
    total = None
    for k, c in zip(range(-half, half + 1), gaussian_weights(window)):
        v = y if k == 0 else F.coalesce(F.lead(y, k).over(w), last) if k > 0 else F.coalesce(F.lag(y, -k).over(w), first)
        total = c * v if total is None else total + c * v
    return total


def hold_last(v: Column, w) -> Column:
    """Fill dropouts with the last value, leading ones with 0; place 0 takes place 1's value."""
    held = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    nxt = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 1)), F.lit(0.0))
    return F.when(F.row_number().over(w) == 1, nxt).otherwise(held)
