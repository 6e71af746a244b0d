"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token-id files.

Each stage reads the Parquet table that the one before it kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import containment, hyperlang, mixing, neardup, planefile, simhash
from tracewright.llm.common import scratch, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a recognised language go.

    Null, empty and letterless texts go; rows are judged one by one, whatever their ids; all columns go
    through; an empty table stays empty.
    """
    return hyperlang.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 at 0.8 of five-word shingles: of each group the row with the smallest id stays.

    Every row is a document, also where ids repeat or are null (those come last); texts that are null or
    blank are copies of each other; all columns go through; an empty table stays empty.
    """
    return simhash.keep_first_of_groups(docs, neardup.similar_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go.

    Null and empty texts hold none and stay; rows are judged by their texts, whatever their ids; all columns
    go through; an empty table stays empty, an empty benchmark takes nothing.
    """
    return containment.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents repeat by their sources' target rates, in a global random order.

    A null source is one of its own; null texts count one unit; rows of one id (null id: of one text) draw
    alike; all columns go through; an empty table stays empty.
    """
    return mixing.mix_sources(docs, mixing.source_rates(docs)).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token-id shards; a row a document (and copy), read back from the files.

    Null and empty texts are their end id alone; rows with null id come first; repeated rows have their ids
    each; an empty table gives no row.
    """
    return planefile.encoded_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Language vectors, fingerprint components and tokens have no SQL form; tests hold each stage against
#: a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows.

    What a stage wrote on its way is deleted once its result stands. Odd rows fare as the stages say; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
