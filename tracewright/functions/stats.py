"""Robust scores, fits, rank statistics and histograms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracewright.sources.scratch import written


def mad_z(df: DataFrame, col: str, keys: list[str], out: str, strict: bool = True) -> DataFrame:
    """Robust z-score within each series.

    Strict: deviation over 1.4826 MAD, over the population deviation where that is nearly 0, else 0.
    Otherwise: deviation over the MAD, or the deviation, or 1, plus 1e-9.
    """
    p = Window.partitionBy(*keys)
    d = df.withColumn("__m", F.median(col).over(p)).withColumn("__d", F.abs(F.col(col) - F.col("__m")))
    d = d.withColumn("__mad", F.median("__d").over(p)).withColumn("__s", F.stddev_pop(col).over(p))
    dev = F.col(col) - F.col("__m")
    if strict:
        scale = 1.4826 * F.col("__mad")
        z = F.when(scale >= 1e-9, dev / scale).when(F.col("__s") >= 1e-9, dev / F.col("__s")).otherwise(F.lit(0.0))
    else:
        z = dev / (F.when(F.col("__mad") > 0, F.col("__mad")).when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(1.0)) + 1e-9)
    return d.withColumn(out, z).drop("__m", "__d", "__mad", "__s")


def line_fit(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """``n, slope, r2``: least squares; 0 and 0 with fewer than three points or no span."""
    a = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"), F.regr_slope(y, t).alias("s"), F.regr_r2(y, t).alias("r"))
    ok = (F.col("n") >= 3) & (F.col("span") > 1e-9)
    return a.select(*keys, "n", F.when(ok, F.col("s")).otherwise(F.lit(0.0)).alias("slope"), F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0))))).otherwise(F.lit(0.0)).alias("r2"))


def whole_in_order(keys: list[str], t: str) -> Window:
    """All rows of a segment, summed in order of time."""
    return Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def parabola_fit(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """``n, t0, t1, a, r2, rms``: y against time since the segment's start; ``a`` is twice the
    quadratic coefficient. All sums come from one grouped pass of moments, over rows in order of time: so a fit
    on a threshold falls to the same side whatever the spread of the rows."""
    w = whole_in_order(keys, t)
    u = df.withColumns({"__u": F.col(t) - F.min(t).over(w), "__y": F.col(y) - F.avg(y).over(w)})
    sums = {f"s{k}": F.sum(F.pow("__u", F.lit(float(k)))) for k in range(1, 5)} | {"y0": F.sum("__y"), "y1": F.sum(F.col("__u") * F.col("__y")), "y2": F.sum(F.col("__u") * F.col("__u") * F.col("__y")), "yy": F.sum(F.col("__y") * F.col("__y"))}
    m = u.groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"), *[v.alias(k) for k, v in sums.items()])
    n, s1, s2, s3, s4, y0, y1, y2, yy = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2", "yy"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    c0 = (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / det
    c1 = (n * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / det
    c2 = (n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / det
    ok = (n >= 3) & (F.abs(det) > 1e-12)
    f = m.withColumns({"c0": F.when(ok, c0), "c1": F.when(ok, c1), "c2": F.when(ok, c2)})
    res = F.greatest(yy - F.col("c0") * y0 - F.col("c1") * y1 - F.col("c2") * y2, F.lit(0.0))
    f = f.withColumn("res", res)
    r2 = F.when(yy > 1e-9, 1 - F.col("res") / yy).when(F.col("res") < 1e-6, F.lit(1.0)).otherwise(F.lit(0.0))
    return f.select(*keys, "n", "t0", "t1", (2 * F.col("c2")).alias("a"), F.when(ok, r2).alias("r2"), F.sqrt(F.col("res") / n).alias("rms"))


def parabola_rows(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Every row with its segment's fit (``a, r2, rms, n, t0, t1, vspan``) and its own residual ``res``.
    All moments are windows over one partitioning; rows of segments without a fit are left out."""
    w = Window.partitionBy(*keys)
    u = df.withColumns({"__u": F.col(t) - F.min(t).over(w), "__y": F.col(y) - F.avg(y).over(w)})
    power = lambda k: F.sum(F.pow("__u", F.lit(float(k)))).over(w)
    u = u.withColumns({
        "n": F.count("*").over(w), "t0": F.min(t).over(w), "t1": F.max(t).over(w), "vspan": F.greatest(F.max(y).over(w) - F.min(y).over(w), F.lit(1.0)),
        **{f"__s{k}": power(k) for k in range(1, 5)}, "__y0": F.sum("__y").over(w), "__y1": F.sum(F.col("__u") * F.col("__y")).over(w),
        "__y2": F.sum(F.col("__u") * F.col("__u") * F.col("__y")).over(w), "__yy": F.sum(F.col("__y") * F.col("__y")).over(w),
    })
    n, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("n", "__s1", "__s2", "__s3", "__s4", "__y0", "__y1", "__y2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    u = u.withColumn("__det", det).where("n >= 3 AND abs(__det) > 1e-12").withColumns({
        "__c0": (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / F.col("__det"),
        "__c1": (n * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / F.col("__det"),
        "__c2": (n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / F.col("__det"),
    })
    u = u.withColumn("res", F.col("__y") - F.col("__c0") - F.col("__c1") * F.col("__u") - F.col("__c2") * F.col("__u") * F.col("__u"))
    u = u.withColumn("__sq", F.sum(F.col("res") * F.col("res")).over(w))
    r2 = F.when(F.col("__yy") > 1e-9, 1 - F.col("__sq") / F.col("__yy")).when(F.col("__sq") < 1e-6, F.lit(1.0)).otherwise(F.lit(0.0))
    u = u.withColumns({"a": 2 * F.col("__c2"), "r2": r2, "rms": F.sqrt(F.col("__sq") / n), "res_step": F.abs(F.col("res") - F.lag("res").over(w.orderBy(t)))})
    return u.drop(*[c for c in u.columns if c.startswith("__")])


def parabola_quality(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """``n, t0, t1, a, r2, rms, rms_frac, jump_frac, t_worst``: the fit of each segment, its residuals'
    size and largest step over the span of ``y``, and the time of the largest."""
    f = parabola_rows(df, keys, t, y)
    one = lambda c: F.first(c).alias(c)
    return f.groupBy(*keys).agg(
        *map(one, ("n", "t0", "t1", "a", "r2", "rms")), (F.first("rms") / F.first("vspan")).alias("rms_frac"),
        (F.coalesce(F.max("res_step"), F.lit(0.0)) / F.first("vspan")).alias("jump_frac"), F.max_by(t, F.struct(F.round(F.abs("res"), 9), -F.col(t))).alias("t_worst"),
    )


#: Rows of a range in which values are ordered; the ranges stand side by side.
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, order: list[str], n: str | None = None) -> tuple[DataFrame, int, int]:
    """``df`` as a table with ``__part``, ascending ranges of ``order``, and ``__base``, the rows (or the sum
    of ``n``) of the ranges before; and the numbers of its rows and of that sum altogether.

    ``df`` is computed once. The number of ranges follows its rows; a row a range comes to the driver.
    """
    size = F.count(F.lit(1)) if n is None else F.sum(n)
    seen = Observation(f"ordered-{uuid.uuid4().hex}")  # counted as the table is written
    t = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("total")).withColumns({"__part": F.lit(0), "__base": F.lit(0).cast("long")}), "ordered")
    rows, total = seen.get["rows"], seen.get["total"]
    parts = rows // RANGE_ROWS + 1
    if parts == 1:
        return t, rows, total or 0
    t = written(t.drop("__part", "__base").repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    below, bases = 0, []
    for r in t.groupBy("__part").agg(size.alias("n")).orderBy("__part").collect():
        bases.append((r["__part"], below))
        below += r.n
    return t.join(F.broadcast(df.sparkSession.createDataFrame(bases, "__part int, __base long")), "__part"), rows, total or 0


def numbered(df: DataFrame, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """Adds each row's place (from 1) in ``order``, which tells rows apart, and the number of rows."""
    t, rows, _ = ranged(df, order)
    t = t.withColumn(out, F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))).drop("__part", "__base")
    return t if total is None else t.withColumn(total, F.lit(rows).cast("long"))


def before(df: DataFrame, order: str, n: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``n`` over the rows of smaller ``order`` (distinct within ``keys``).

    With keys this is a window. Without, it is one in each of the ranges of ``order``.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))
    t, _, _ = ranged(df, [order], n)
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn(out, F.col("__base") + F.coalesce(F.sum(n).over(w), F.lit(0))).drop("__part", "__base")


def median_of(df: DataFrame, col: str) -> Column:
    """The exact median of a whole column, from counts of distinct values; null if there are none."""
    t, _, total = ranged(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n")), [col], "__n")
    upto = F.col("__base") + F.sum("__n").over(Window.partitionBy("__part").orderBy(col))
    at = lambda place: F.min(F.when(F.col("__upto") >= place, F.col(col)))
    return F.lit(t.withColumn("__upto", upto).agg((at((total + 1) // 2) + at(total // 2 + 1)) / 2).first()[0])


def rank_auc(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """``auc, n_pos, n_neg``: chance that a positive outranks a negative, ties half; null if a side is
    empty. Mid-ranks come from counts of distinct scores, so only those are ordered."""
    keys = keys or []
    c = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    c = before(c, score, "q", "below", keys)
    c = c.withColumn("win", F.col("p") * (F.col("below") + F.col("q") / 2))
    out = c.groupBy(*keys).agg(F.sum("win").alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return out.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def average_rank(df: DataFrame, col: str, out: str, n: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, col, out``: the rank of each value with ties averaged, from counts ``n`` of rows."""
    keys = keys or []
    c = df.groupBy(*keys, col).agg(F.sum(n).alias("__n"))
    c = before(c, col, "__n", "__below", keys)
    return c.select(*keys, col, (F.col("__below") + (F.col("__n") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """``rho, n``: the correlation of the ranks of ``x`` and ``y``, null where one of them never varies.

    The rows are counted by their two values once; ranks are joined to the counts. The mean of the ranks of
    n rows is ``(n + 1) / 2``, so the moments are centred as they are summed."""
    keys = keys or []
    c = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__k")), "pairs")
    r = c.join(average_rank(c, x, "__rx", "__k", keys), [*keys, x]).join(average_rank(c, y, "__ry", "__k", keys), [*keys, y])
    if keys:
        r = r.withColumn("__all", F.sum("__k").over(Window.partitionBy(*keys)))
    else:
        r = r.withColumn("__all", F.lit(c.agg(F.sum("__k")).first()[0]).cast("long"))
    dx, dy = (F.col(v) - (F.col("__all") + 1) / 2 for v in ("__rx", "__ry"))
    sums = r.groupBy(*keys).agg(F.sum(F.col("__k") * dx * dy).alias("xy"), F.sum(F.col("__k") * dx * dx).alias("xx"), F.sum(F.col("__k") * dy * dy).alias("yy"), F.coalesce(F.sum("__k"), F.lit(0)).alias("n"))
    return sums.select(*keys, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


def histogram(df: DataFrame, col: str, bins: int, keys: list[str]) -> DataFrame:
    """Density over equal bins from minimum to maximum; the maximum is in the last bin."""
    w = Window.partitionBy(*keys)
    r = df.where(F.col(col).isNotNull()).withColumns({"__lo": F.min(col).over(w), "__hi": F.max(col).over(w), "__n": F.count("*").over(w)})
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.floor((F.col(col) - F.col("__lo")) / width), F.lit(bins - 1)).cast("long")
    return r.where("__hi > __lo").groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), (F.count("*") / (F.first("__n") * F.first(width))).alias("density"))
