"""Shared helpers: the shared scratch folder, written tables, bounded batches of rows and what workers keep."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set on a local master (tests, one machine);
    on a cluster, where executors would not see it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tracewright-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables and files that ``scratch`` names inside are deleted at the end, when whoever read them has
    written its own result. Those of a DataFrame that is still to be read must be made outside."""
    mark = len(_MADE)
    try:
        yield
    finally:
        hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        for path in _MADE[mark:]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)
        del _MADE[mark:]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage, survives the loss of executors and, unlike a cache, holds no memory.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` has them (case does not count)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of ``likely``'s bitmap: 4 MiB, broadcast.
LIKELY_BITS = 1 << 25


def likely(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``, which is false only where ``key`` is not in the column of ``ids``.

    A bitmap of the ids' hashes says so, of one size whatever their number, so rows that need not meet the ids are
    not shuffled. A true flag may be chance: an exact join has to follow.
    """
    where, bucket, bits = unused(rows, "where", "bucket", "bits")
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(LIKELY_BITS)) + 1
    held = ids.select(place(ids.columns[0]).alias(where)).withColumn(bucket, F.bitmap_bucket_number(where)).repartition(bucket)
    maps = written(held.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(where)).alias(bits)), "likely")
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col(bucket), "left").withColumn(flag, hit).drop(bucket, bits)


_HELD: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between batches: one object at a time.

    Workers are reused from stage to stage, so the tables of a stage gone by would else stay in memory
    beside the next one's.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Give a worker's tables and free pages back, as idle workers count beside the next stage."""
    _HELD.clear()
    trimmed()


def trimmed() -> None:
    """Give free pages back but keep what ``held`` holds, for the next task of the same stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose sizes sum to ``most`` at most (a larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of column ``text`` have ``most`` bytes together at most (a
    longer one stands alone): what is converted to Python objects at once is bounded by bytes."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        for i, j in text_slices(sizes, most):
            yield b.slice(i, j - i)
