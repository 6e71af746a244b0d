"""Substring dedup by sliding sentence spans.

A text is cut into sentences, after ``.``, ``!`` or ``?`` and at line ends. At every sentence a span
starts and one ends: the shortest run of at least ``RUN`` sentences with at least ``WORDS`` words (every
longer run that repeats is made of such runs). All spans of all texts are hashed, the hashes that occur more than once are found by a grouped minimum that combines on
the map side, and a join marks every occurrence but the first (by ``doc_id``, then text, then place).
Sentences under a marked span are removed.

Only a "sentence" of over ``LONG`` words, which text without punctuation makes, is cut further, where its
own words say: so a passage pasted into such text is found whatever stands before it, but for a few
words at its ends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import partitions, slices, trimmed, unused, written

RUN, WORDS, LONG, PIECE = 2, 15, 30, 12
_STOP = re.compile(r"[.!?][^\w\s]*$")


def pieces(words: list[str]) -> list[int]:
    """Where the pieces of a sentence end: one of over ``LONG`` words is cut after words whose hash is
    the smallest of five words around them, and after ``PIECE`` words where none is."""
    n = len(words)
    if n <= LONG:
        return [n]
    h = [zlib.crc32(w.encode()) for w in words]
    ends, last = [], 0
    for i in range(2, n - 2):
        x = h[i]
        if x < h[i - 1] and x < h[i + 1] and x < h[i - 2] and x < h[i + 2]:
            ends += range(last + PIECE, i + 1, PIECE)
            last = i + 1
            ends.append(last)
    ends += range(last + PIECE, n, PIECE)
    ends.append(n)
    return ends


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence."""
    out: list[list[str]] = []

    def close(words: list[str]) -> None:
        if len(words) <= LONG:
            out.append(words)
            return
        at = 0
        for end in pieces(words):
            out.append(words[at:end])
            at = end

    for line in text.split("\n"):
        words = line.split()
        at = 0
        for i, word in enumerate(words, 1):
            if not word[-1].isalnum() and _STOP.search(word):
                close(words[at:i])
                at = i
        if at < len(words):
            close(words[at:])
    return out


def starts_of(text: str, found: list[list[str]]) -> list[int]:
    """Where each sentence's first word stands; only white space stands between words."""
    out, at = [], 0
    for words in found:
        for k, w in enumerate(words):
            at = text.index(w, at)
            if not k:
                out.append(at)
            at += len(w)
    return out


def spans_of(found: list[list[str]], run: int = RUN, words: int = WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """128-bit hashes of the spans by their first sentence, which that is, and which is the last."""
    n = len(found)
    digests = [xxhash.xxh3_128_digest(" ".join(w).encode()) for w in found]
    upto = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
    at = np.arange(n)
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + words, "left"), at + run)
    starts = np.minimum(np.searchsorted(upto, upto[1:] - words, "right") - 1, at + 1 - run)
    pairs = np.concatenate([(at * (n + 1) + ends)[ends <= n], (starts * (n + 1) + at + 1)[starts >= 0]])
    first, end = np.divmod(np.unique(pairs), n + 1)
    digest = xxhash.xxh3_128_digest
    return [digest(b"".join(digests[i:j])) for i, j in zip(first.tolist(), end.tolist())], first, end - 1


def sentence_spans(rows: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``h, g, row, first, last, again`` of every span of every text of ``row, text``; ``h`` and ``g`` are
    the halves of its hash, ``again``: the same span stands earlier in the text."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            parts: list[tuple] = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                h, first, last = spans_of(sentences(text.as_py() or ""), run, words)
                met: set[bytes] = set()
                again = [x in met or met.add(x) is not None for x in h] if len(set(h)) < len(h) else [False] * len(h)
                halves = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                parts.append((halves[:, 0], halves[:, 1], np.full(len(h), row), first, last, again))
            yield batch(parts)
        trimmed()

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, bool)
        columns = [np.concatenate([np.asarray(p[k], kind) for p in parts]) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h", "g", "row", "first", "last", "again"])

    return rows.mapInArrow(spans, "h long, g long, row long, first int, last int, again boolean")


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a long in column ``row`` that tells all rows apart and ascends by ``doc_id`` (null
    last), then text hash.

    Where ids are unique they are the numbers. Else the rows are dealt by ranges of id and text hash
    (rows equal in both are interchangeable and spread over partitions), sorted, numbered and written,
    so that the numbers hold whatever is lost later.
    """
    given = F.col("doc_id").cast("long")
    if docs.groupBy(given.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null").isEmpty():
        return docs.withColumn(row, given)
    i, h, r = unused(docs, "i", "h", "r")
    keyed = docs.withColumns({i: given, h: F.xxhash64(F.col("text").cast("string")), r: F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), F.col(i).asc_nulls_last(), h, r).sortWithinPartitions(F.col(i).asc_nulls_last(), h)
    return written(dealt.drop(i, h, r).withColumn(row, F.monotonically_increasing_id()), "numbered")


def repeated_spans(rows: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``row, first, last`` of every occurrence but the first of every repeated span of ``row, text``."""
    spans = sentence_spans(rows, run, words)
    first = spans.groupBy("h", "g").agg(F.min("row").alias("origin"), F.count("*").alias("n")).where("n > 1").select("h", "g", "origin")
    first = written(first, "repeated-spans")  # as a table of its own, the join has two plain exchanges and a frequent span's rows can be split
    return spans.join(first, ["h", "g"]).where("again or row != origin").select("row", "first", "last")


def remove_repeated_spans(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated spans, and ``n_sentences, n_removed`` added.

    Every row is a document of its own, whether its id is repeated or null: of equal rows one stays whole.
    Columns of ``docs`` under the two new names give way, all others go through. A null text stays null
    and, like an empty one, has no sentence; a copy of an earlier document loses its spans' sentences, to
    the empty text if all are covered; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    row, marks = unused(docs, "row", "marks")
    docs = numbered(docs.select(*names), row)
    marked = repeated_spans(docs.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), run, words)
    marked = marked.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("first", "last")).alias(marks))
    joined = docs.withColumn("text", F.col("text").cast("string")).join(marked, row, "left").select(*names, marks)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in slices(batches, at, 1 << 20):
            texts, n, removed = [], [], []
            for text, marks in zip(b.column(at), b.column(b.num_columns - 1)):
                text, marks = text.as_py(), marks.as_py()
                found = sentences(text or "")
                gone = np.zeros(len(found) + 1, np.int64)
                for m in marks or ():
                    gone[m["first"]] += 1
                    gone[m["last"] + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                if gone.any():
                    edges = [*starts_of(text, found), len(text)]
                    text = text[: edges[0]] + "".join(text[x:y] for x, y, g in zip(edges, edges[1:], gone) if not g)
                texts.append(text)
                n.append(len(found))
                removed.append(int(gone.sum()))
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])
        trimmed()

    schema = StructType([*joined.schema.fields[:-1], StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(clean, schema)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_spans(docs)
    return out.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text")
