"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be very long, so their Jaccard similarity says little and
whole-document MinHash finds nothing. Items are therefore partitioned by size (number of distinct
five-word shingles, by powers of two), and for each size class every document is read in windows of
twice the class size, half overlapping, so that an item's passage always lies in one window of a
comparable size. Each window gets a one-permutation MinHash sketch (the smallest hash of each of
``4 x size`` bins); a window that shares a bin's minimum with an item is a candidate. Candidates are
verified on the shingles themselves: the exact share of the item's distinct shingles that the whole
document holds.

Three things bound the work. A document with fewer shingles than the threshold asks of a class's
smallest item is not read for that class, so the sketches of a slice have at most 14 cells a shingle.
An item is looked up by the rarer of its sketch entries only, so a header that many items share makes
no candidates (the smallest class keeps every shingle and looks up the ``n - ceil(0.8 n) + 1`` rarest,
which no document with 0.8 of them can miss). And equal items are one class, searched once.

The items' sketches are broadcast in blocks of at most ``block_items`` items and ``block_bytes`` of
text (a longer item stands alone), whatever their number: the items are a query set held against all
documents, one pass for each block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import held, released, slices, text_slices, trimmed, unused, written

SHINGLE = 5
THRESHOLD = 0.8
#: Items of the smallest class have sketches that hold every shingle, as few bins would miss them.
SMALL = 16
#: Bytes hashed and sketch cells filled at a time.
PIECE, CELLS = 1 << 19, 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x))) for x in (_ODD, inverse))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: list = []


def _piece_words(joined: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece that ends in white space."""
    starts = np.flatnonzero(~white & np.append(True, white[:-1]))
    ends = np.flatnonzero(white & np.append(False, ~white[:-1]))
    if len(joined) > PIECE + 1:
        up, down = _powers(len(joined) + 1)  # a piece of one huge word
    else:
        if not _POWERS:
            _POWERS.append(_powers(PIECE + 2))
        up, down = _POWERS[0]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)])
    return _mix((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has; ``PIECE`` bytes at a time."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[joined]
    hashes, starts, at = [], [], 0
    while at < len(joined):
        cut = len(joined)
        if cut - at > PIECE:
            near = np.flatnonzero(white[at : at + PIECE])
            cut = at + int(near[-1]) + 1 if len(near) else at + PIECE + int(white[at + PIECE :].argmax()) + 1
        h, s = _piece_words(joined[at:cut], white[at:cut])
        hashes.append(h)
        starts.append(s + at)
        at = cut
    edge = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), edge), prepend=0)


def shingle_hashes(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in order, and how many each text has.

    Words end at ASCII white space. A text with fewer words than ``n`` has its whole sequence as one
    shingle; a text without words has none.
    """
    word, words = word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    shingles = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    left = np.repeat(np.minimum(words, n), shingles)
    out = left.astype(np.uint64)
    last = len(word) - 1
    for k in range(n):
        more = _mix(out * _ODD + word[np.minimum(at + k, last)])
        out = more if k == 0 else np.where(left > k, more, out)
    return out, shingles


def _shingles(text: str, n: int) -> Iterator[tuple[str, ...]]:
    w = text.encode().split()
    if not w:
        return iter(())
    return zip(*(islice(w, k, None) for k in range(n))) if len(w) >= n else iter([tuple(w)])


def shingles_of(text: str, n: int = SHINGLE) -> set[tuple[str, ...]]:
    return set(_shingles(text, n))


def size_class(n: int) -> int:
    """The power of two at or above a number of shingles, ``SMALL`` at least."""
    return max(SMALL, 1 << (n - 1).bit_length())


def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % bins


class ItemIndex:
    """Sketches of a block of items, by size class."""

    def __init__(self, items: list[tuple[int, str]], n: int = SHINGLE, threshold: float = THRESHOLD) -> None:
        self.items, self.n, self.threshold = items, n, threshold
        self.sizes = np.zeros(len(items), np.int64)
        #: size: (entries ascending, their items, shingles of the smallest item)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        entries: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, j in text_slices([len(t) for _, t in items], PIECE):
            hashes, counts = shingle_hashes([t.encode() for _, t in items[i:j]], n)
            for k, part in enumerate(np.split(hashes, np.cumsum(counts)[:-1]), i):
                h = np.unique(part)
                self.sizes[k] = len(h)
                if len(h):
                    size = size_class(len(h))
                    if size > SMALL:
                        h = h[np.unique(bin_of(h, 4 * size), return_index=True)[1]]  # ascending, so the smallest of each bin
                    entries.setdefault(size, []).append((h, k))
        for size, found in entries.items():
            values, met = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
            hashes, owners = [], []
            for h, k in found:
                rare = h[np.argsort(met[np.searchsorted(values, h)], kind="stable")]
                most = len(h) - math.ceil(threshold * len(h) - 1e-9) + 1 if size == SMALL else len(h) // 2 + 1
                hashes.append(rare[:most])
                owners.append(np.full(min(most, len(h)), k, np.int64))
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            self.classes[size] = (h[order], owner[order], int(self.sizes[[k for _, k in found]].min()))

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``text * items + item`` of each pair where a window of the text shares a bin's minimum with
        the item, ascending."""
        out = [np.zeros(0, np.int64)]
        text_of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        for size, (minima, owner, least) in self.classes.items():
            long = counts >= self.threshold * least - 1e-9
            if not long.any():
                continue
            mine = long[text_of]
            h, t = hashes[mine], text_of[mine]
            if size == SMALL:
                out.append(self._shared(t, h, minima, owner))
                continue
            blocks = np.where(long, -(-counts // size), 0)
            block = (np.cumsum(blocks) - blocks)[t] + place[mine] // size
            out += self._windows(h, block, np.repeat(np.arange(len(counts)), blocks), size, minima, owner)
        pairs = np.unique(np.concatenate(out))
        return pairs[counts[pairs // max(1, len(self.items))] >= self.threshold * self.sizes[pairs % max(1, len(self.items))] - 1e-9]

    def _windows(self, h: np.ndarray, block: np.ndarray, text_of: np.ndarray, size: int, minima: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """Hits of the windows (a block and the next of the same text), ``CELLS`` sketch cells at a time."""
        bins = 4 * size
        step = max(1, CELLS // bins)
        for b in range(0, len(text_of), step):
            n = min(step + 1, len(text_of) - b)
            i, j = np.searchsorted(block, [b, b + n])
            sketch = np.full(n * bins, _MOST)
            np.minimum.at(sketch, (block[i:j] - b) * bins + bin_of(h[i:j], bins), h[i:j])
            sketch = sketch.reshape(n, bins)
            same = np.flatnonzero(text_of[b + 1 : b + n] == text_of[b : b + n - 1])
            for k in same.tolist():  # ascending, so the next block is still its own
                np.minimum(sketch[k], sketch[k + 1], out=sketch[k])
            rows = text_of[b : b + min(step, n)]
            filled = sketch[: len(rows)] != _MOST
            yield self._shared(np.repeat(rows, filled.sum(axis=1)), sketch[: len(rows)][filled], minima, owner)

    def _shared(self, rows: np.ndarray, values: np.ndarray, minima: np.ndarray, owner: np.ndarray) -> np.ndarray:
        low = np.searchsorted(minima, values, "left")
        hit = np.flatnonzero(minima[np.minimum(low, len(minima) - 1)] == values)
        if not len(hit):
            return np.zeros(0, np.int64)
        low, n = low[hit], np.searchsorted(minima, values[hit], "right") - low[hit]
        out = [np.zeros(0, np.int64)]
        edges = np.searchsorted(np.cumsum(n), np.arange(CELLS, int(n.sum()) + CELLS, CELLS))
        start = 0
        for end in np.minimum(edges + 1, len(n)).tolist():  # so many pairs at a time
            m = n[start:end]
            at = np.repeat(low[start:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out.append(np.unique(np.repeat(rows[hit[start:end]], m) * len(self.items) + owner[at]))
            start = end
        return np.unique(np.concatenate(out))

    def contained(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """``text, item id, shared, item shingles`` of every pair at or over the threshold."""
        hashes, counts = shingle_hashes([t.encode() for t in texts], self.n)
        if not len(hashes) or not len(self.items):
            return
        text, item = np.divmod(self.candidates(hashes, counts), len(self.items))
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):
            asked = [(self.items[k][0], shingles_of(self.items[k][1], self.n)) for k in item[a:b].tolist()]
            wanted = set().union(*(s for _, s in asked))
            there = {x for x in _shingles(texts[text[a]], self.n) if x in wanted}
            for item_id, s in asked:
                shared = len(s & there)
                if shared >= self.threshold * len(s) - 1e-9:
                    yield int(text[a]), item_id, shared, len(s)


def item_blocks(asked: DataFrame, block_items: int, block_bytes: int) -> list[DataFrame]:
    """``item_id, text`` in blocks bounded by rows and by bytes of text.

    Items are dealt to many small buckets by hash and only the buckets' sizes are collected; runs of
    buckets make a block. A bucket over the bounds is dealt again by another hash; what is left over
    them after four deals (one item, or copies of one) is a block.
    """

    size = F.octet_length("text").cast("long")

    def cut(part: DataFrame, n: int, total: int, depth: int) -> list[DataFrame]:
        if n <= block_items and total <= block_bytes or n == 1 or depth == 4:
            return [part]
        most = 16 * max(-(-n // block_items), -(-total // block_bytes))
        bucket = F.pmod(F.xxhash64("item_id", "text", F.lit(depth)), F.lit(most))
        sizes = part.groupBy(bucket.alias("k")).agg(F.count("*").alias("n"), F.sum(size).alias("b")).orderBy("k").collect()
        out, first, rows, held = [], 0, 0, 0
        for i, r in enumerate(sizes):
            if i > first and (rows + r.n > block_items or held + r.b > block_bytes):
                out += cut(part.where(bucket.between(sizes[first].k, sizes[i - 1].k)), rows, held, depth + 1)
                first, rows, held = i, 0, 0
            rows, held = rows + r.n, held + r.b
        return out + cut(part.where(bucket.between(sizes[first].k, sizes[-1].k)), rows, held, depth + 1)

    n, total = asked.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return cut(asked, n, total, 0)


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _asked(items: DataFrame) -> DataFrame:
    """``item_id, text, class``: items with words, lower-cased; equal texts are one class."""
    text = _low("text")
    return items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.xxhash64(text).alias("class")).where("text != ''")


def _sent(asked: DataFrame, block_items: int, block_bytes: int) -> list[tuple[str, Broadcast]]:
    """The classes' texts in broadcast blocks of a checked size, each under a name of its own."""
    classes = asked.groupBy(F.col("class").alias("item_id"), "text").agg(F.lit(1)).select("item_id", "text")
    context = asked.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast([(r.item_id, r.text) for r in b.collect()])) for b in item_blocks(classes, block_items, block_bytes)]


def contaminated_classes(docs: DataFrame, asked: DataFrame, threshold: float = THRESHOLD, block_items: int = 20_000, slice_bytes: int = PIECE, block_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, class, n_shared, n_item``: each pair of a document and a class of equal items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _low("text").alias("text"))
    out = None
    for name, sent in _sent(asked, block_items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], name=name, sent=sent) -> Iterator[pa.RecordBatch]:
            index = held((name,), lambda: ItemIndex(sent.value, threshold=threshold))
            for b in slices(batches, 1, slice_bytes):
                found = [(b.column(0)[t].as_py(), *rest) for t, *rest in index.contained(b.column(1).to_pylist())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["doc_id", "class", "n_shared", "n_item"])
            trimmed()

        part = rows.mapInArrow(run, "doc_id long, class long, n_shared long, n_item long")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: each pair of a document and an item of which
    it holds at least ``threshold`` of the distinct shingles.

    Texts are lower-cased; words end at ASCII white space. Items without words (null, empty) match
    nothing; items of fewer than five words are one shorter shingle, which only documents of just these
    words hold; null texts match nothing; repeated rows are searched one by one, equal items together
    (``contaminated_classes``), with a row for each of them here; empty tables give an empty result.
    Other columns of either table are ignored.
    """
    asked = _asked(items)
    pairs = contaminated_classes(docs, asked, threshold, **settings).join(asked.select("item_id", "class"), "class")
    return pairs.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_items: int = 20_000, slice_bytes: int = PIECE, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, judged one by one in the scan.

    Nothing is shuffled. Where the items need several blocks, each block's pass reads what the one
    before it kept. Null and empty texts hold no item; null and repeated ids, repeated rows and columns
    of any name go through; an empty table stays empty.
    """
    blocks = _sent(_asked(items), block_items, block_bytes)
    for k, (name, sent) in enumerate(blocks):
        (low,) = unused(docs, "low")

        def run(batches: Iterator[pa.RecordBatch], name=name, sent=sent) -> Iterator[pa.RecordBatch]:
            index = held((name,), lambda: ItemIndex(sent.value, threshold=threshold))
            for whole in batches:
                at = whole.num_columns - 1
                for b in slices(iter([whole]), at, slice_bytes):
                    keep = np.ones(b.num_rows, bool)
                    keep[[t for t, *_ in index.contained(b.column(at).to_pylist())]] = False
                    yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(keep))
            released()

        schema = docs.schema
        docs = docs.withColumn(low, _low("text")).mapInArrow(run, schema)
        if k + 1 < len(blocks):
            docs = written(docs, "decontaminated")
    return docs


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT 'd' AS kind, doc_id AS id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents
  UNION ALL SELECT 'i', item_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE w != ['']))
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item, count(*) / any_value(n.n) AS containment
FROM s i JOIN s d ON d.s = i.s AND d.kind = 'd' JOIN (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id) n ON n.id = i.id
WHERE i.kind = 'i' GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)
"""
