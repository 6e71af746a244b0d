"""Importance resampling towards a target distribution, over hashed n-gram features.

Features are runs of 1 to ``max_n`` words; a feature's bucket is its CRC-32 modulo the number of buckets.
The buckets' counts over the corpus and over the target give each bucket a gain, the log ratio of the
smoothed shares; a document's weight is the mean gain of its features; and a Gumbel number hashed from its
id turns the highest weights into a draw without replacement.

Words and CRCs come from a vectorised byte automaton (``bytewords``): bytes of Arrow's UTF-8 buffers are
classified by a lookup table, boundaries found by differences, and table-driven CRCs advanced over all
word starts simultaneously. A task sums its features in one array of buckets before anything is shuffled.

Ranks need no single sorted task: scores are whole numbers, so their counts (a bounded table) name the
score at which the draw ends; only the rows at or above it are dealt by ranges of score and id, sorted,
written, and numbered from the partitions' row counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm import bytewords as B
from tracewright.llm.common import partitions, slices, trimmed, unused, written

BUCKETS, MAX_N, MIN_WORDS, SEED, PERCENT = 10_000, 1, 20, 2024, 10
#: Digits, a-z (texts are lower-cased first) and all bytes of characters above ASCII.
WORD = B.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
SLICE = 1 << 20
#: Rows of a partition of the sorted draw.
DRAW_ROWS = 100_000


def features(texts: pa.Array, buckets: int, max_n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of run the texts' numbers with the buckets of their features."""
    data, at = B.terminated(texts)
    data = B.LOWER[data]
    starts, ends = B.word_bounds(data, WORD)
    of = np.searchsorted(at, starts, "right") - 1
    runs = B.run_crcs(data, starts, ends, of, max_n)
    return np.bincount(of, minlength=len(texts)), [(of[first], (crc % np.uint32(buckets)).astype(np.int64)) for first, crc in runs]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """``bucket, n``: how many features of all texts (column ``text``) each bucket has, if any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, 0, SLICE):
            for _, bucket in features(b.column(0), buckets, max_n)[1]:
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])
        trimmed()

    part = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """``floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` of each bucket, s and t its
    counts in ``docs`` and ``target``, S and T their sums. Only the buckets' counts reach the driver."""

    def counts(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(df, buckets, max_n).collect():  # one row a bucket at most
            out[r.bucket] = r.n
        return out

    s, t = counts(docs), counts(target)
    big_s, big_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(y + 1) * big_s / (float(x + 1) * big_t))) for x, y in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight``, the floored mean gain of a text's features (none: 0)."""
    buckets = len(gains)
    at = docs.columns.index("text")
    names = [*docs.columns, "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            words, runs = features(b.column(at), buckets, max_n)
            n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for of, bucket in runs:
                n += np.bincount(of, minlength=len(n))
                np.add.at(total, of, gains[bucket])
            added = [words.astype(np.int64), n, np.floor_divide(total, np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, added)], names)
        trimmed()

    new = [StructField(c, LongType()) for c in names[-3:]]
    return docs.mapInArrow(weigh, StructType([*docs.schema.fields, *new]))


def gumbel(seed: int, key: Column) -> Column:
    """``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))``, h the first 8 hex digits of ``sha256("<seed>:<key>")``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, chosen: Column, order: list[Column], n: int) -> DataFrame:
    """The ``chosen`` rows with ``rank``, their place (from 1) in ``order``; ``n`` is about their number.

    Dealt by ranges, sorted and written, a row's place is the rows of the partitions before its own plus
    its number there. Rows must differ in ``order``, so that no range is one key.
    """
    spark = rows.sparkSession
    (place,) = unused(rows, "place")
    dealt = rows.where(chosen).repartitionByRange(max(partitions(spark), n // DRAW_ROWS + 1), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn(place, F.monotonically_increasing_id()), "ranked")
    before, sizes = 0, []
    for r in dealt.groupBy(F.shiftright(place, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        sizes.append((r.part, before))
        before += r.n
    part, base = unused(dealt, "part", "base")
    offsets = spark.createDataFrame(sizes, f"{part} long, {base} long")
    placed = dealt.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part)
    return placed.withColumn("rank", F.col(base) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(part, base, place)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with ``n_words, n_features, weight, score, rank``.

    Of the N rows with ``min_words`` words or more, the ``percent * N // 100`` with the highest score
    (``weight`` plus a Gumbel number hashed from ``seed`` and ``doc_id``) are drawn and get their rank,
    ties to the smaller id (null last), rows of one id in any order; all others have a null rank.

    ``target`` is read by its ``text``. A null text has no words and weight 0; a null id hashes as empty;
    rows of one id share their Gumbel number and are weighed and drawn each by itself; an empty target
    gives gains by the corpus alone; an empty table gives an empty result. Columns of ``docs`` under the
    new names give way, all others go through.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    names = [c for c in (keep or docs.columns) if c not in added]
    carried = list(dict.fromkeys([*names, "doc_id", "text"]))
    (at,) = unused(docs, "at")
    gains = bucket_gains(docs, target, buckets, max_n)
    rows = weighed(docs.select(*[F.col("text").cast("string").alias("text") if c == "text" else c for c in carried]), gains, max_n)
    scored = rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    scored = scored.drop(*[c for c in carried if c not in [*names, "doc_id"]]).withColumn(at, F.monotonically_increasing_id())
    scored = written(scored, "weighed")  # read for the counts, the draw and the rest; its row numbers hold whatever is lost
    counts = scored.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")).collect()  # scores lie within about 120 000 whole numbers
    wanted = percent * sum(r.n for r in counts) // 100
    cut, above = None, 0
    for r in sorted(counts, key=lambda r: -r.score):
        if above >= wanted:
            break
        cut, above = r.score, above + r.n
    rank = F.lit(None).cast("long")
    if cut is None:
        return scored.select(*names, *added[:-1], rank.alias("rank"))
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    top = ranked(scored, chosen, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(at)], above)
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return top.select(*names, *added).unionByName(scored.where(~chosen).select(*names, *added[:-1], rank.alias("rank")))


def op11_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = importance_resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: CRC-32 over the bytes of each distinct word, by the byte table built in ``poly``.
OP11_SQL = r"""
WITH poly AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
split AS (
  SELECT 0 AS side, doc_id AS id, rowid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
  UNION ALL SELECT 1, item_id, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS (SELECT side, rowid, unnest(ws) AS w FROM split),
vocab AS (SELECT side, w, count(*) AS n FROM uses GROUP BY 1, 2),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM vocab)),
bucketed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, poly.t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, poly),
sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM vocab JOIN bucketed USING (w) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM sums) + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM sums) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums),
means AS (
  SELECT rowid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM uses JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (
  SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN means USING (rowid) WHERE side = 0),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, rank, n_features AS n_words FROM scored LEFT JOIN drawn USING (doc_id)
"""
