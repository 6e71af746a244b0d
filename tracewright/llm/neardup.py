"""Near-duplicate groups by similarity: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, and chains of such pairs.

Candidates are the groups of the SimHash operator, its BK-trees over the fingerprints of the same
shingles. At that similarity two 64-bit SimHashes are often ten or more bits apart, though, where no
sharding of BK-trees selects anything, so pairs that lie beyond its radius come from banded MinHash:
rows of ``BANDS`` keys of ``ROWS`` minima. A pair of similarity s shares no key with probability
``(1 - s**4)**24``, 3e-6 at 0.8 and less above. Every link is then confirmed on the shingles themselves,
so a group of either kind parts where its texts differ more.

Texts that are equal but for case and white space are one node. A node's SimHash group is one more key
beside its bands. Nodes that share a key are a bucket;
buckets with the same nodes (as those of a lone pair mostly are) are kept once. Only nodes of buckets
have their shingles hashed again, where their texts are read (a bitmap of their ids goes there, no text is
shuffled), and dealt out. In a bucket a node is held against the members of
every group it has not joined yet, those that matched last first, until one is similar: the bucket's
spanning links connect exactly what its similar pairs connect, and a large group costs about one
comparison a member.

No task holds a bucket whole: one whose shingles take over ``BUCKET_BYTES`` is cut in blocks of half of
that by its nodes' hashes, and every two blocks meet in a part of their own. A bucket of b blocks ships
each of its nodes b times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import likely, released, slices, written
from tracewright.llm.containment import SHINGLE, shingle_hashes
from tracewright.llm.simhash import components, near_duplicate_groups

SIMILARITY = 0.8
BANDS, ROWS = 24, 4
BUCKET_BYTES = 32 << 20
_SEEDS = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def normal(text: str | None) -> bytes:
    """A-Z lower-cased, single blanks between ASCII-white-space words."""
    return b" ".join((text or "").encode().lower().split())


def digests_of(norms: list[bytes]) -> list[pa.Array]:
    """The halves of the texts' 128-bit hashes."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, norms)), "<i8").reshape(-1, 2)
    return [pa.array(halves[:, k]) for k in (0, 1)]


def band_keys(norms: list[bytes], words: int = SHINGLE) -> tuple[list[list[int]], np.ndarray]:
    """The band keys of each text (none for a text without words), and its number of shingles."""
    hashes, counts = shingle_hashes(norms, words)
    out: list[list[int]] = [[] for _ in norms]
    full = np.flatnonzero(counts)
    if not len(full):
        return out, counts
    starts = (np.cumsum(counts) - counts)[full]
    keys = np.empty((len(full), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for flip, factor in _SEEDS[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat((hashes ^ flip) * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    for i, row in zip(full.tolist(), keys.view(np.int64).tolist()):
        out[i] = row
    return out, counts


def shingle_sets(norms: list[bytes], words: int = SHINGLE) -> list[np.ndarray]:
    hashes, counts = shingle_hashes(norms, words)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < least * len(b) - 1e-9:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def bucket_links(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning links of the graph of similar sets, as pairs of positions."""
    groups: list[list[int]] = []
    links = []
    for i, s in enumerate(sets):
        joined = [i]
        apart = []
        for g in groups:
            hit = next((k for k, j in enumerate(g) if similar(sets[j], s, least)), None)
            if hit is None:
                apart.append(g)
                continue
            links.append((g[hit], i))
            g.insert(0, g.pop(hit))
            joined = g + joined if len(g) >= len(joined) else joined + g
        groups = [joined, *apart]
    return links


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, hi, lo`` (the text's hash), ``size`` (its shingles) and ``keys`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 18):
            norms = [normal(x.as_py()) for x in b.column(1)]
            keys, sizes = band_keys(norms, words)
            yield pa.RecordBatch.from_arrays([b.column(0), *digests_of(norms), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "hi", "lo", "size", "keys"])
        released()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hi long, lo long, size long, keys array<long>")


def _shingles(docs: DataFrame, words: int) -> DataFrame:
    """``hi, lo, shingles`` (sorted hashes as bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 1 << 19):
            norms = [normal(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*digests_of(norms), pa.array([s.tobytes() for s in shingle_sets(norms, words)], pa.binary())], ["hi", "lo", "shingles"])
        released()

    return docs.select("text").mapInArrow(run, "hi long, lo long, shingles binary")


def _links(members: DataFrame, least: float) -> DataFrame:
    """``a, b`` of ``key, part, node, shingles``: similar nodes of each part of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []

        def close() -> pa.RecordBatch:
            found = bucket_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for key, part, node, s in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if (key, part) != last:
                    if len(sets) > 1:
                        yield close()
                    last, nodes, sets = (key, part), [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(s.as_py(), np.uint64))
        yield close()
        released()

    dealt = members.repartition("key", "part").select("key", "part", "node", "shingles").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _parts(blocks: Column) -> Column:
    """The parts that a node's block stands in: one with each of the bucket's ``blocks``, its own included."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    pair = lambda k: F.least(own, k) * blocks + F.greatest(own, k)
    return F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), pair))


def similar_groups(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, component_id`` of every row: the smallest ``doc_id`` reachable over chains of texts
    with a Jaccard similarity of ``least`` or more, itself included.

    Null, empty and blank texts are copies of each other; a row with null ``doc_id`` gets its group's
    smallest id, and a text that only such rows have links nothing; repeated rows and ids are kept as they
    come; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(_nodes(docs, words), "neardup-rows")
    # The copies of a text have the same keys; the smallest id stands for them.
    nodes = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys")).where("doc_id is not null")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")  # numbers that hold once written
    grouped = near_duplicate_groups(docs, words).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("group"))
    grouped = written(grouped, "neardup-simhash")
    keys = F.array_append("keys", F.xxhash64(F.lit("simhash"), "group"))
    placed = nodes.where("size > 0").join(grouped, "doc_id").select("node", "size", F.explode(keys).alias("key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    # Blocks of half the bytes, as two meet; a bucket within the bytes stays whole.
    blocks = F.when(F.col("total") * 8 <= bucket_bytes, F.lit(1)).otherwise(F.ceil(F.col("total") * 16 / bucket_bytes)).cast("long")
    buckets = written(buckets.groupBy("n", "low", "high", "mark").agg(F.min("key").alias("key"), F.max("total").alias("total")).select("key", blocks.alias("blocks")), "neardup-buckets")
    members = written(placed.join(buckets, "key").select("key", "node", F.explode(_parts(F.col("blocks"))).alias("part")), "neardup-members")
    # Texts are not shuffled: a bitmap tells which to hash again, and the hashes bring all places of a node at once.
    places = members.groupBy("node").agg(F.collect_list(F.struct("key", "part")).alias("places"))
    asked = written(nodes.join(places, "node").select("doc_id", "hi", "lo", "node", "places"), "neardup-asked")
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", asked.select("doc_id"), "asked").where("asked")
    placed = _shingles(texts, words).join(asked.select("hi", "lo", "node", "places"), ["hi", "lo"]).select("node", "shingles", F.inline("places"))
    links = _links(placed, least)
    label = components(written(links, "neardup-links"))
    moved = nodes.join(label, "node", "left").select("hi", "lo", "doc_id", F.coalesce("component", "node").alias("component"))
    moved = written(moved, "neardup-moved")
    first = moved.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = moved.join(first, "component").select("hi", "lo", "component_id")
    return rows.select("doc_id", "hi", "lo").join(of_node, ["hi", "lo"], "left").select("doc_id", "component_id")
