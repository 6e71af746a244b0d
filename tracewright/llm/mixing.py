"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is the number of its units that the target weights ask for over the
units it has. Every document draws how often it appears by inverting the Poisson distribution of that
mean at a uniform number hashed from its id and a seed, is exploded into as many copies, and all
copies are put in one global random order by a hash of id, copy and seed. The hash is uniform, so a
row's place in the order is known from it alone: it goes to the partition that the hash's share of the
range names, without sampling the rows for range bounds first.

A draw needs no other row, so it is the same for any partitioning and any retry. Means over 16 are
drawn as sums of independent parts, which keeps the inversion exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import partitions, unused, written

PART = 16.0
#: Characters of mixed text that a partition sorts.
PARTITION = 64 << 20
DEPTH = 80
KEY_BITS = 60


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) with 52 bits from the MD5 of the keys joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with cdf(k) > u, for a mean of ``PART`` at most."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        more = a["cdf"] <= u
        return F.struct(p.alias("p"), F.when(more, a["cdf"] + p).otherwise(a["cdf"]).alias("cdf"), F.when(more, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, lambda a: a["k"])


def poisson_count(mean: Column, *keys: Column) -> Column:
    """A Poisson draw with any mean, hashed from the keys."""
    parts = F.greatest(F.ceil(mean / PART).cast("int"), F.lit(1))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_inverse(uniform(*keys, j), mean / parts))
    return F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """``source, n_docs, n_units, rate``: mean repetitions for each source.

    Units are code points of text, at least 1 a document. With ``weights``, a source's share of the
    output is its weight over the sum of weights of the sources present (0 if it has none); without,
    shares go as units to the power ``temperature``. ``total`` is the expected size of the output in
    units (default: as large as the input). A null source is a source of its own, named ``""`` in
    ``weights``. Null and empty texts count 1; an empty table gives no row; other columns are ignored.
    """
    units = F.greatest(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1)).cast("long")
    sums = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), units.alias("u")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("u").alias("n_units"))
    if weights is None:
        sums = sums.withColumn("w", F.pow(F.col("n_units").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "source string, w double")
        sums = sums.join(given, "source", "left").na.fill(0.0, ["w"])
    sums = written(sums, "source-units")
    all_w, units = sums.agg(F.sum("w"), F.sum("n_units")).first()
    size = float(units or 0) if total is None else float(total)
    rate = F.col("w") / F.lit(all_w) * F.lit(size) / F.col("n_units") if all_w else F.lit(0.0)
    return sums.select("source", "n_docs", "n_units", rate.alias("rate"))


def mixture_parts(docs: DataFrame, rates: DataFrame) -> int:
    """Partitions for the mixture: by the text that the rates are expected to give, at least the session's
    number of shuffle partitions."""
    if "n_units" in rates.columns:
        size = rates.agg(F.sum(F.col("n_units") * F.col("rate"))).first()[0]
    else:
        units = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.length(F.col("text").cast("string"))).alias("n"))
        size = units.join(rates.select("source", "rate"), "source").agg(F.sum(F.col("n") * F.col("rate"))).first()[0]
    return max(partitions(docs.sparkSession), int((size or 0) // PARTITION) + 1)


def mix_sources(docs: DataFrame, rates: DataFrame, seed: int = 7, small_sources: int = 100_000) -> DataFrame:
    """``docs`` replicated by their sources' rates, in a global random order.

    Adds ``mix_rate, mix_copies, mix_copy`` (from 1) and ``mix_key``, by which partitions and rows
    within them ascend. Columns of ``docs`` under these names give way.

    Documents are told apart by id (null: by text); repeated rows draw alike. A source without a row
    in ``rates`` gets none; a null text is a text like any other; an empty table gives an empty result.
    The rates are broadcast only if they have ``small_sources`` rows at most. Other columns go through,
    whatever their names. Copies have keys of their own, so only rows equal in id share a partition.
    """
    added = ["mix_rate", "mix_copies", "mix_copy", "mix_key"]
    names = [c for c in docs.columns if c not in added]
    of, key = unused(docs, "source_name", "draw_key")
    source = rates.select(F.col("source").alias(of), F.col("rate").alias("mix_rate"))
    few = rates.limit(small_sources + 1).count() <= small_sources
    draw = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = docs.select(*names, F.coalesce(F.col("source").cast("string"), F.lit("")).alias(of), draw.alias(key))
    joined = named.join(F.broadcast(source) if few else source, of)
    drawn = joined.withColumn("mix_copies", poisson_count(F.col("mix_rate"), F.lit(seed), F.col(key))).where("mix_copies > 0")
    copies = drawn.select(*names, key, "mix_rate", "mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy"))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key), F.col("mix_copy").cast("string"), F.lit("order"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    n = mixture_parts(docs, rates)
    width = -(-(1 << KEY_BITS) // n)
    placed = copies.withColumn("mix_key", order).repartitionById(n, F.expr(f"int(mix_key div {width}L)"))
    return placed.sortWithinPartitions("mix_key", "doc_id", "mix_copy").drop(key)


def op2_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sources(docs, source_rates(docs))
    return out.select("doc_id", "source", F.round("mix_rate", 9).alias("rate"), F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.col("mix_key").alias("position_key"), "lang", "n_chars", "text")


#: The same draws in SQL (means here are under 16, so one part each); ``rate`` is rounded on both sides.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(source, '') AS s, greatest(length(coalesce(text, '')), 1) AS u FROM documents),
r AS (SELECT s, sqrt(CAST(sum(u) AS DOUBLE)) AS w, CAST(sum(u) AS DOUBLE) AS units FROM d GROUP BY s),
rates AS (SELECT s, w / (SELECT sum(w ORDER BY s) FROM r) * (SELECT sum(units) FROM r) / units AS rate FROM r),
cdf AS (
  SELECT s, 0 AS k, exp(-rate) AS p, exp(-rate) AS c, rate FROM rates
  UNION ALL SELECT s, k + 1, p * rate / (k + 1), c + p * rate / (k + 1), rate FROM cdf WHERE k < 80),
drawn AS (
  SELECT d.*, rates.rate, CAST(('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR) || ':1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS v
  FROM d JOIN rates USING (s)),
n AS (
  SELECT drawn.doc_id, (SELECT count(*) FROM cdf WHERE cdf.s = drawn.s AND cdf.c <= drawn.v) AS copies FROM drawn)
SELECT doc_id, source, round(rate, 9) AS rate, copies, copy,
  CAST(('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR) || ':order'), 1, 15)) AS BIGINT) AS position_key,
  lang, n_chars, text
FROM (SELECT drawn.*, copies, unnest(range(1, copies + 1)) AS copy FROM drawn JOIN n USING (doc_id))
"""
