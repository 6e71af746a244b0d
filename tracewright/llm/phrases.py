"""Phrase collocation mining by Suffix-sigma.

Texts are cut into pieces at punctuation and line ends, pieces into words. Every word begins a suffix of
its piece, truncated to ``MAX_N`` words. Suffixes are dealt by language and first word, sorted
reverse-lexicographically, and one stack of open prefixes per task counts all runs of 1 to ``MAX_N`` words:
a prefix is closed, and its count final, when a suffix comes that doesn't begin with it. The parts that a
phrase's score needs are joined afterwards.

Nothing is gathered under one key. A task sorts and merges equal suffixes before it ships them, as blocks of
text; a frequent first word is cut further by the words that follow, at bounds taken from a bounded sample
of suffixes (they decide balance only, not results); and the prefixes left open at the edge of a task are
summed across tasks, the only other rows that are shipped being the frequent prefixes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm import bytewords as B
from tracewright.llm.common import partitions, slices, trimmed, written

MIN_N, MAX_N, MIN_COUNT, TOP = 2, 4, 30, 2000
#: Within a suffix a byte 0 ends each word, below anything that a word may hold: bytes 0 and 1 of a text are
#: written as 1 1 and 1 2, which keeps words apart and in order.
END, ESCAPE = "\x00", "\x01"
BREAK = B.byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
WORD = ~(BREAK | B.byte_class((0x09, 0x09), (0x20, 0x20)))
SLICE = 1 << 20
#: Bytes of suffixes that a task merges at a time, and of text whose suffixes make a partition.
BUFFER, PARTITION = 24 << 20, 32 << 20
#: Documents and suffixes that the partitions' bounds are taken from, at most about.
SAMPLE_DOCS, SAMPLE_KEYS = 4000, 100_000


def escaped(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, ESCAPE, ESCAPE + "\x02")
    return pc.replace_substring(texts, END, ESCAPE + ESCAPE)


def suffixes(texts: pa.Array, most: int) -> pa.Array:
    """Every word of every piece with the ``most - 1`` after it in the piece, each word ended by byte 0."""
    data, _ = B.terminated(escaped(pc.fill_null(texts, "")))
    data = B.LOWER[data]
    starts, ends = B.word_bounds(data, WORD)
    n = len(starts)
    if not n:
        return pa.array([], pa.large_string())
    size = ends - starts + 1  # with its end
    into = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(into[-1], np.uint8)  # all words, each ended by byte 0
    inside = np.ones(into[-1], bool)
    inside[into[1:] - 1] = False
    flat[inside] = data[WORD[data]]
    piece = np.cumsum(BREAK[data])[starts]
    last = np.arange(n)
    for k in range(1, most):
        same = np.flatnonzero(piece[k:] == piece[:-k]) if k < n else []
        last[same] = np.asarray(same) + k
    length = into[last + 1] - into[:-1]
    offsets = np.concatenate([[0], np.cumsum(length)])
    gather = np.arange(offsets[-1], dtype=np.int64) + np.repeat(into[:-1] - offsets[:-1], length)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(flat[gather]))


def merged(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The different suffixes in ascending byte order and how often each came."""
    found = pc.value_counts(pa.chunked_array(parts))
    keys, n = found.field("values"), found.field("counts").to_numpy()
    order = pc.sort_indices(keys)
    return keys.take(order), n[order.to_numpy()]


def sorted_buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """``lang``, suffixes and counts, ``BUFFER`` bytes of suffixes (of all languages together) at a time."""
    held: dict[str, list[pa.Array]] = {}
    total = 0
    for b in slices(batches, 1, SLICE):
        langs = b.column(0)
        for lang in pc.unique(langs).to_pylist():
            found = suffixes(b.column(1).filter(pc.equal(langs, lang)), most)
            if len(found):
                held.setdefault(lang, []).append(found)
                total += found.nbytes
        if total > BUFFER:
            for lang in list(held):
                yield lang, *merged(held.pop(lang))
            total = 0
    for lang in list(held):
        yield lang, *merged(held.pop(lang))


def shared_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes ``data[at[i]:at[i + 1]]``: words of each, first words shared with the one before, and the
    positions of all word ends."""
    ends = np.flatnonzero(data == 0)
    words = np.searchsorted(ends, at)
    length = np.diff(at)
    before = np.concatenate([[0], length[:-1]])
    place = np.arange(len(data))
    other = place - np.repeat(before, length)  # the same place in the suffix before, or past its end
    differs = np.flatnonzero((other >= np.repeat(at[:-1], length)) | (data[other] != data))
    stop = np.concatenate([differs, [len(data)]])[np.searchsorted(differs, at[:-1])]
    shared = np.searchsorted(ends, np.minimum(stop, at[1:])) - words[:-1]
    shared[0] = 0
    return np.diff(words), shared, ends


def prefix_counts(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of sorted ``lang, suffix, n``: those that a task sees whole if they reach
    ``least``, those at its edges always. The empty prefix counts a language's words.

    The stack (``open``) holds the counts of the last suffix's prefixes between batches; within a batch,
    prefixes close where the next suffix shares fewer words, all of them at once.
    """
    lang, last, open_, edge = None, b"", np.zeros(most + 1, np.int64), np.zeros(most + 1, bool)

    def closed(data: np.ndarray, at: np.ndarray, n: np.ndarray, more: bool) -> pa.RecordBatch:
        """Count ``n`` of suffixes that follow the last one (the first here); keep the last one's prefixes
        open if ``more``."""
        nonlocal last, open_, edge
        words, shared, ends = shared_words(data, at)
        first_end = np.searchsorted(ends, at[:-1])
        texts, counts = [], []
        now, now_edge = np.zeros(most + 1, np.int64), np.zeros(most + 1, bool)
        for d in range(most + 1):
            has = words >= d
            begin = np.flatnonzero(has & (shared < d)) if d else np.array([0])
            if not len(begin):
                continue
            if d and begin[0] != 0 and has[0]:
                raise AssertionError("a suffix shares words with none before it")
            total = np.add.reduceat(np.where(has, n, 0), begin)
            at_edge = np.zeros(len(begin), bool)
            if has[0]:
                total[0] += open_[d]
                at_edge[0] = edge[d]
            emit = at_edge | (total >= least) if d else np.ones(1, bool)
            if more and has[-1]:
                now[d], now_edge[d] = total[-1], at_edge[-1]
                emit[-1] = False
            elif has[-1] and not more:
                emit[-1] = True  # cut by the end of the task
            for i, total_i in zip(begin[emit].tolist(), total[emit].tolist()):
                if total_i:
                    texts.append(data[at[i] : ends[first_end[i] + d - 1] + 1].tobytes().decode() if d else "")
                    counts.append(total_i)
        open_, edge = now, now_edge
        last = data[at[-2] : at[-1]].tobytes()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

    def finished() -> pa.RecordBatch:
        return closed(np.frombuffer(last, np.uint8), np.array([0, len(last)]), np.zeros(1, np.int64), False)

    for b in batches:
        langs = b.column(0)
        changes = np.flatnonzero(pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(langs) > 1 else np.array([], int)
        for i, j in zip([0, *changes.tolist()], [*changes.tolist(), len(langs)]):
            if i == j:
                continue
            if langs[i].as_py() != lang:
                if lang is not None:
                    yield finished()
                lang, last = langs[i].as_py(), b""
                open_, edge = np.zeros(most + 1, np.int64), np.ones(most + 1, bool)
            keys = b.column(1)[i:j].cast(pa.large_string())
            _, offsets, data = keys.buffers()
            at = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + j - i + 1]
            data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
            n = b.column(2)[i:j].to_numpy()
            if last:
                data = np.concatenate([np.frombuffer(last, np.uint8), data])
                at, n = np.concatenate([[0], at + len(last)]), np.concatenate([[0], n])
            yield closed(data, at, n, True)
    if lang is not None:
        yield finished()
    trimmed()


def range_bounds(docs: DataFrame, parts: int, n_docs: int, most: int) -> list[tuple[bytes, bytes]]:
    """``parts - 1`` pairs of language and suffix that cut the suffixes of a sample of documents evenly."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    every = max(1, -(-SAMPLE_DOCS * 200 // SAMPLE_KEYS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            langs = b.column(0)
            for lang in pc.unique(langs).to_pylist():
                found = suffixes(b.column(1).filter(pc.equal(langs, lang)), most)
                picked = found.take(pa.array(np.arange(0, len(found), every)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(picked), pa.string()), picked.cast(pa.string())], ["lang", "key"])

    sample = docs.sample(False, share, 11).mapInArrow(keys, "lang string, key string")
    got = sorted((r.lang.encode(), r.key.encode()) for r in sample.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_KEYS).collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def phrase_counts(docs: DataFrame, most: int = MAX_N, least: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of 1 to ``most`` words with ``n >= least``, and of the empty
    phrase (``words`` 0), the number of the language's words. Words of a phrase are ended by byte 0 and
    escaped; see ``spaced``."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(partitions(docs.sparkSession), (size or 0) // PARTITION + 1)
    bounds = range_bounds(docs, parts, n_docs, most)
    parts = len(bounds) + 1
    by_lang: dict[str, list[bytes]] = {}
    for lang, key in bounds:
        by_lang.setdefault(lang.decode(), []).append(key)
    langs = sorted(lang.encode() for lang, _ in by_lang.items())
    below = {lang: sum(len(by_lang[x.decode()]) for x in langs if x < lang.encode()) for lang in by_lang}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``part, lang, n, block``: the suffixes of a buffer that go to one partition and came ``n`` times,
        a line each, in descending order."""
        for lang, keys, n in sorted_buffers(batches, most):
            first = below[lang] if lang in below else sum(len(by_lang[x.decode()]) for x in langs if x < lang.encode())
            at = [0, *(bisect_left(keys, key, key=lambda s: s.as_py().encode()) for key in by_lang.get(lang, ())), len(keys)]
            for k, (i, j) in enumerate(zip(at, at[1:])):
                counts = n[i:j]
                for c in np.unique(counts).tolist():
                    mine = np.flatnonzero(counts == c)[::-1] + i
                    block = "\n".join(keys.take(pa.array(mine)).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([lang]), pa.array([c], pa.int64()), pa.array([block])], ["part", "lang", "n", "block"])
        trimmed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from prefix_counts(batches, most, least)

    dealt = docs.mapInArrow(blocks, "part int, lang string, n long, block string").repartitionById(parts, "part")
    ordered = dealt.select("lang", F.explode(F.split("block", "\n")).alias("key"), "n").sortWithinPartitions(F.col("lang").desc(), F.col("key").desc())
    found = ordered.select("lang", "key", "n").mapInArrow(count, "lang string, phrase string, n long")
    whole = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return whole.where((F.col("n") >= least) | (F.col("phrase") == "")).withColumn("words", F.length("phrase") - F.length(F.replace("phrase", F.lit(END), F.lit(""))))


def spaced(phrase: str) -> F.Column:
    """A phrase as read: words joined by a space, bytes 0 and 1 as in the text."""
    out = F.replace(F.expr(f"substr({phrase}, 1, length({phrase}) - 1)"), F.lit(END), F.lit(" "))
    return F.replace(F.replace(out, F.lit(ESCAPE * 2), F.lit(END)), F.lit(ESCAPE + "\x02"), F.lit(ESCAPE))


def collocations(docs: DataFrame, min_n: int = MIN_N, max_n: int = MAX_N, least: int = MIN_COUNT, top: int = TOP, percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of ``min_n`` to ``max_n``
    words that occur ``least`` times or more.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut (lowest score, then shortest first
    part), ``n`` the language's words; ``score`` is ``floor(scale * a / (l + r))``, exact. A phrase inside a
    longer one that occurs ``percent`` of its times or more goes. Repeated rows count each; a null text is
    empty, a null language ``und``; an empty table gives an empty result; other columns are ignored.
    """
    counts = written(phrase_counts(docs, max_n, least), "phrase-counts")
    whole = counts.where("words > 0")
    phrases = whole.where(F.col("words") >= min_n).select("lang", "phrase", "words", F.col("n").alias("a"))

    def part(first: F.Column, size: F.Column) -> F.Column:
        """``size`` words of the phrase from word ``first`` (from 0)."""
        return F.concat(F.array_join(F.slice(F.split("phrase", END), first + 1, size), END), F.lit(END))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", part(F.lit(0), F.col("cut")).alias("first"), part(F.col("cut"), F.col("words") - F.col("cut")).alias("rest"))
    left = whole.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = whole.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"cast({scale}BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))

    spans = F.flatten(F.transform(F.sequence(F.lit(min_n), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(0), F.col("words") - size), lambda i: part(i, size))))
    inside = phrases.where(F.col("words") > min_n).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("longer") < F.lit(percent).cast("decimal(3,0)") * wide("a")))
    kept = kept.select("lang", spaced("phrase").alias("phrase"), "a", "x.l", "x.r", "x.score")

    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # a frequent language's best come from 64 parts
    best = kept.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top).drop("place")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY 1),
grams AS (
  SELECT lang, ws[i : i + k - 1] AS g, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, range(1, 5) t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, g, k, count(*) AS n FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cuts AS (
  SELECT p.lang, p.g, p.k, p.n AS a, c, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * p.n // (x.n + y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k >= 2) p
  JOIN f x ON x.lang = p.lang AND x.g = p.g[1 : c] JOIN f y ON y.lang = p.lang AND y.g = p.g[c + 1 : p.k]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, g[i : i + s - 1] AS g, max(n) AS longer
  FROM (SELECT lang, g, n, s, unnest(range(1, k - s + 2)) AS i FROM f, range(2, 4) t(s) WHERE s < k) GROUP BY 1, 2),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM worst LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN words USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
