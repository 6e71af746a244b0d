"""SimHash near-duplicate groups: fingerprints, sharded BK-trees and connected components.

Method. Every document gets a 64-bit SimHash of its three-word shingles. Rows with one fingerprint
collapse at once (a partial aggregate), so copies cost nothing further. By the pigeonhole rule two
fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks, hence each
distinct fingerprint goes to ``radius + 1`` shards, one for each block's value, and every close
pair meets in some shard. A shard builds one BK-tree (children keyed by integer Hamming distance to
the parent) and looks up each fingerprint with only the edges within the radius followed.

The shard trees are not broadcast: that would pull all fingerprints through the driver. A tree lives
in the task that owns its shard. Shards over ``shard_limit`` fingerprints are dealt out again by
blocks of the bits that are still free (up to two times), which keeps the pigeonhole guarantee.

Each shard yields a spanning forest of its links (at most one per fingerprint), never all pairs of a
group. The forest's components come from rounds of minimum-label star contraction on written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import likely, unused, written
from tracewright.llm.spans import numbered

SEED = 42
_ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, ASCII-white-space words, ``words``-word shingles with
    repeats, XXH64 with seed 42. Null, empty and blank texts have no shingle and give 0."""
    norm = b" ".join((text or "").encode().lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - words)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[words - 1 : words - 1 + n - 1].tolist(), len(norm)] if n > 1 else [len(norm)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = [digest(norm[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int((((2 * total) > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over 64-bit integers that also keeps the components of what it holds."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the held values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new


def _forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links of one shard's distinct fingerprints, as pairs of positions."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, links = BKTree(), []
    for i, fp in enumerate(fps):
        for j in tree.within(fp, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
        tree.add(fp)
    return links


def _blocks(free: list[int], count: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(free), count)]


def _key(level: list[tuple[int, ...]], bits: list[int]):
    """The value of ``fp`` on the given bits, as one long."""
    mask = sum(1 << b for b in bits)
    mask -= (mask >> 63) << 64
    return F.col("fp").bitwiseAND(F.lit(mask))


def _sharded(nodes: DataFrame, radius: int, chosen: list[int], path: tuple[int, ...]) -> DataFrame:
    """Each fingerprint once for each block of the bits outside ``chosen``."""
    free = [b for b in range(64) if b not in chosen]
    keys = []
    for i, block in enumerate(_blocks(free, radius + 1)):
        keys.append(F.struct(F.lit(".".join(map(str, (*path, i)))).alias("path"), _key([], [*chosen, *block]).alias("bits")))
    return nodes.select("fp", "node", F.explode(F.array(*keys)).alias("k")).select("fp", "node", "k.path", "k.bits")


def close_links(nodes: DataFrame, radius: int = 3, shard_limit: int = 4096) -> DataFrame:
    """``a, b``: links between nodes (``fp`` distinct, ``node``) that connect exactly those
    fingerprints that chains of pairs within ``radius`` bits connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        last = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                out.extend((held[i][1], held[j][1]) for i, j in _forest([x[0] for x in held], radius))
            held.clear()

        for b in batches:
            for path, bits, fp, node in zip(*(c.to_pylist() for c in b.columns)):
                if (path, bits) != last:
                    close()
                    last = (path, bits)
                held.append((fp & 0xFFFFFFFFFFFFFFFF, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    def linked(shards: DataFrame) -> DataFrame:
        return shards.repartition("path", "bits").select("path", "bits", "fp", "node").sortWithinPartitions("path", "bits", "fp").mapInArrow(run, "a long, b long")

    def split(shards: DataFrame, chosen_of: dict[str, list[int]], depth: int) -> DataFrame:
        sizes = shards.groupBy("path", "bits").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit)
        hot = written(sizes, "simhash-hot-shards")
        if depth == 0 or hot.isEmpty():
            return linked(shards)
        cold = linked(shards.join(hot.select("path", "bits"), ["path", "bits"], "left_anti"))
        warm = shards.join(hot.select("path", "bits"), ["path", "bits"], "left_semi")
        parts, bits_of = [], {}
        for p in [r[0] for r in hot.select("path").distinct().collect()]:
            chosen = chosen_of[p]
            path = tuple(map(int, p.split(".")))
            parts.append(_sharded(warm.where(F.col("path") == p).select("fp", "node"), radius, chosen, path))
            free = [b for b in range(64) if b not in chosen]
            bits_of |= {".".join(map(str, (*path, i))): sorted([*chosen, *block]) for i, block in enumerate(_blocks(free, radius + 1))}
        again = parts[0]
        for p in parts[1:]:
            again = again.unionByName(p)
        return cold.unionByName(split(written(again, "simhash-shards"), bits_of, depth - 1))

    top = {str(i): block for i, block in enumerate(_blocks(list(range(64)), radius + 1))}
    return split(_sharded(nodes, radius, [], ()), top, 2)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with a link to another.

    Alternating large-star and small-star rounds over the links; each round is one written table, and
    the rounds stop when a round changes nothing. Self-links and repeated links are allowed.
    """
    edges = written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        edges = written(
            small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where(F.col("u") != F.col("v"))
            .distinct(),
            "components",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def near_duplicate_groups(docs: DataFrame, words: int = 3, radius: int = 3, shard_limit: int = 4096) -> DataFrame:
    """Near-duplicate groups of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Returns one row per input row: ``doc_id, fp, component_id`` with the smallest ``doc_id``
    reachable over chains of fingerprints at most ``radius`` bits apart, itself included.

    Defined cases: null, empty and blank texts have fingerprint 0 and link to each other; repeated
    rows and repeated ids are kept as they come; a row with null ``doc_id`` takes part under the
    group's smallest id (null if the group has none); an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    links = close_links(nodes.where(F.col("node").isNotNull()), radius, shard_limit)
    label = components(links)
    moved = nodes.join(label, "node").select("fp", F.col("component").alias("component_id"))
    first = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    first = written(first, "simhash-first")  # a table of its own: the join has two plain exchanges, and a frequent fingerprint's rows can be split
    return fps.join(first, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicate_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_of_groups(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame] = near_duplicate_groups) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id (null last), of those with one id
    the one whose text hash is smallest.

    ``groups_of`` gives ``doc_id, component_id`` of every row of ``doc_id, text``. Every row is a document
    of its own, whether its id is repeated or null: a row goes only if an earlier row of its own group
    stays. Null, empty and blank texts are copies of each other; all columns go through, whatever their
    names; an empty table gives an empty result.
    """
    row, gone = unused(docs, "row", "gone")
    rows = numbered(docs, row)
    groups = written(groups_of(rows.select(F.col(row).alias("doc_id"), "text")), "simhash-groups")
    copies = groups.where("component_id != doc_id").select(F.col("doc_id").alias(row))
    # Only rows that a bitmap of the copies can't rule out are shuffled, whole texts as they are.
    marked = likely(rows, row, copies, gone)
    stay, asked = marked.where(~F.col(gone)).select(docs.columns), marked.where(F.col(gone)).join(copies, row, "left_anti").select(docs.columns)
    return stay.union(asked)
