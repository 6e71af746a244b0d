"""Results kept as JSON lines and as a table that is renewed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Lines that are no whole result are kept here as they are.
CORRUPT = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema with ``_corrupt_record``; a line that can't be read has that alone."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Renew a stored table: partitions of ``keys`` that ``new`` has are replaced, all others stay untouched.

    No stored row is read or moved. Nothing new changes nothing; a key's rows are replaced as a whole, so a
    repeated run is harmless.
    """
    new.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
