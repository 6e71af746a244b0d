"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so no alphabet is fixed).
An n-gram binds its letters, each permuted by a roll as often as letters follow it, by elementwise
product. A text bundles (sums) its n-gram vectors over lower-cased letters, runs of anything else
counting as one blank. A language's prototype bundles the normalised vectors of its training texts.
A text gets the language whose prototype has the largest cosine with it.

What cosine a text of a learned language reaches depends on how many different n-grams it has, so the
filter learns a floor for each power of two of that number: half of the score that all but 1 % of the
training texts of this size pass. A short clean text passes a low floor; a long text of another language
falls under a high one.

Everything is summed as integers, so results do not depend on how the rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tracewright.llm.common import held, slices, trimmed, unused, written

DIM = 1024
UNIT = 10_000
#: Languages that are learned at most: a vector each goes to the driver and to the tasks.
LANGUAGES = 1000
NONE = "und"
#: Of the floors: bins of scores, share of training texts that may fall under twice the floor, texts a
#: size needs for a floor of its own, the part of the score that is asked for.
BINS, UNDER, LEAST, PART = 1000, 0.01, 30, 0.5


class Hypervectors:
    """n-gram vectors of a process, made when first met."""

    def __init__(self, n: int = 3, dim: int = DIM, most: int = 32_768) -> None:
        self.n, self.dim, self.most = n, dim, most
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((most, dim), np.int8)
        self.kind = np.full(0x110000, 255, np.uint8)

    @classmethod
    def of(cls, n: int, dim: int) -> Hypervectors:
        return held((cls, n, dim), lambda: cls(n, dim))

    def _letter(self, point: int) -> np.ndarray:
        v = self.letters.get(point)
        if v is None:
            bits = np.random.Generator(np.random.PCG64(point)).integers(0, 2, self.dim, np.int8)
            v = self.letters[point] = bits * 2 - 1
        return v

    def _gram(self, key: int) -> np.ndarray:
        points = [key >> 21 * k & 0x1FFFFF for k in reversed(range(self.n))]
        v = np.ones(self.dim, np.int8)
        for i, p in enumerate(points):
            v = v * np.roll(self._letter(p), self.n - 1 - i)
        return v

    def _points(self, text: str) -> np.ndarray:
        """Lower-cased letters with single blanks between and around; empty without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        if (kind == 255).any():
            for p in np.unique(points[kind == 255]):
                self.kind[p] = chr(p).isalpha()
            kind = self.kind[points]
        letter = kind == 1
        if not letter.any():
            return points[:0]
        points = np.where(letter, points, 32)
        keep = letter | np.append(True, letter[:-1])
        points = points[keep]
        return np.concatenate([[32], points[int(points[0] == 32) :], [32] if points[-1] != 32 else []]).astype(np.int64)

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector as integers, or None without a letter; pieces of 2**20 characters."""
        return self.measured(text)[0]

    def measured(self, text: str) -> tuple[np.ndarray | None, int]:
        """The text's vector and its number of different n-grams (the most in a piece)."""
        total, different = None, 0
        for at in range(0, max(1, len(text)), 1 << 20):
            p = self._points(text[at : at + (1 << 20)])
            if len(p) < self.n:
                if len(p):
                    p = np.append(p, [32] * (self.n - len(p)))
                else:
                    continue
            keys = np.zeros(len(p) - self.n + 1, np.int64)
            for k in range(self.n):
                keys = keys << 21 | p[k : len(p) - self.n + 1 + k]
            grams, counts = np.unique(keys, return_counts=True)
            part = self._sum(grams.tolist(), counts)
            total = part if total is None else total + part
            different = max(different, len(grams))
        return total, different

    def _sum(self, grams: list[int], counts: np.ndarray) -> np.ndarray:
        rows = self.rows
        if len(rows) + len(grams) > self.most:
            rows.clear()
        if len(grams) > self.most:
            half = len(grams) // 2
            return self._sum(grams[:half], counts[:half]) + self._sum(grams[half:], counts[half:])
        for g in grams:
            if g not in rows:
                self.table[len(rows)] = self._gram(g)
                rows[g] = len(rows)
        at = np.fromiter(map(rows.__getitem__, grams), np.int64, len(grams))
        out = np.zeros(self.dim, np.int64)
        for k in range(0, len(at), 512):
            out += (counts[k : k + 512].astype(np.float32) @ self.table[at[k : k + 512]].astype(np.float32)).round().astype(np.int64)
        return out


def _normal(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v.astype(np.float64) ** 2).sum(axis=-1, keepdims=True))
    return v / np.where(size == 0, 1, size)


def training_sample(docs: DataFrame, max_docs: int | None = None) -> DataFrame:
    """``lang, text`` of the rows with both that train: all of them, as they are spread.

    A given ``max_docs`` bounds (in expectation, by a hash of id and text) the texts of each language. They are
    then dealt to eight tasks by that hash, so copies of a text under several ids spread. Of more than
    ``LANGUAGES`` different values of ``lang`` those with most rows train (ties: by name); texts in others
    are judged like any text, by the languages learned.
    """
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rates = {r.lang: min(1.0, (max_docs or r.n) / r.n) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if max_docs is None:
        return usable.join(F.broadcast(spark.createDataFrame([(k,) for k in rates], "lang string")), "lang").select("lang", "text")
    part = spark.createDataFrame([(k, int(v * (1 << 24))) for k, v in rates.items()], "lang string, upto int")
    dealt = F.xxhash64(F.lit("language"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return usable.join(F.broadcast(part), "lang").where(F.pmod(dealt, F.lit(1 << 24)) < F.col("upto")).repartition(8, dealt).select("lang", "text")


def prototypes(docs: DataFrame, n: int = 3, dim: int = DIM, max_docs: int | None = None) -> dict[str, np.ndarray]:
    """Language prototypes from all rows with text and ``lang`` (``training_sample``).

    Tasks' vectors are added up by language; one a language goes to the driver. Null and letterless texts and
    null languages teach nothing; repeated rows count each; an empty table gives no language; other
    columns are ignored.
    """
    return _bundled(training_sample(docs, max_docs), n, dim)


def _bundled(sample: DataFrame, n: int, dim: int) -> dict[str, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Hypervectors.of(n, dim), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                v = space.bundle(text.as_py())
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + (UNIT * _normal(v)).round().astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, v in zip(b.column(0).to_pylist(), b.column(1)):
                sums[lang] = sums.get(lang, 0) + v.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    out: dict[str, np.ndarray] = {}
    kind = "lang string, v array<bigint>"
    got = sample.mapInArrow(run, kind).repartition("lang").mapInArrow(add, kind).toArrow().combine_chunks()
    vectors = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(got) else []
    for lang, v in zip(got.column("lang").to_pylist(), vectors):
        out[lang] = out.get(lang, 0) + v
    return dict(sorted(out.items()))


class Scorer:
    """Language, score and size class of texts against given prototypes."""

    def __init__(self, models: dict[str, np.ndarray], n: int, dim: int) -> None:
        self.n, self.dim, self.names = n, dim, list(models)
        self.matrix = _normal(np.array([*models.values()], np.float64)) if models else np.zeros((0, dim))

    def __call__(self, texts: pa.Array) -> Iterator[tuple[str, float, int]]:
        """Of each text: the language, the cosine (not below 0) and the power of two of its number of
        different n-grams; ``und, 0, -1`` without a letter or a language."""
        space = Hypervectors.of(self.n, self.dim)
        for text in texts:
            text = text.as_py()
            v, different = space.measured(text) if text and self.names else (None, 0)
            if v is None:
                yield NONE, 0.0, -1
                continue
            cos = self.matrix @ _normal(v)
            best = int(cos.argmax())
            yield self.names[best], float(min(1.0, max(0.0, cos[best]))), different.bit_length() - 1


def score_floors(scored: DataFrame, score: str, size: str) -> list[float]:
    """The floor of each size class, from the scores of all rows; a class of few texts has that of the class
    below, the smallest have 0. A count a class and bin goes to the driver."""
    place = F.least(F.lit(BINS - 1), F.floor(F.col(score) * BINS).cast("int"))
    total = np.zeros((32, BINS), np.int64)
    for r in scored.where(F.col(size) >= 0).groupBy(F.col(size).alias("size"), place.alias("place")).agg(F.count("*").alias("n")).collect():
        total[r["size"], r.place] = r.n
    return floors_of(total)


def floors_of(counts: np.ndarray) -> list[float]:
    out = []
    for row in counts:
        n = int(row.sum())
        low = int(np.searchsorted(np.cumsum(row), UNDER * n, "right"))
        out.append(PART * low / BINS if n >= LEAST else out[-1] if out else 0.0)
    return out


def predict(docs: DataFrame, models: dict[str, np.ndarray], n: int = 3, dim: int = DIM, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, with the columns named in ``keep``.

    ``score`` is the cosine with the chosen prototype, not below 0. A null text and a text without a
    letter get ``und`` and 0, as does every text if no language was learned.
    """
    scorer = Scorer(models, n, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 1 << 22):
            langs, scores, _ = zip(*scorer(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])
        trimmed()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    """Documents that only test: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the documents not held out.

    Null, empty and letterless texts are ``und``; null ids are not held out; repeated rows are judged one
    by one; an empty table gives an empty result; other columns are ignored.
    """
    models = prototypes(docs.where(~held_out()), **settings)
    return predict(docs, models).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, max_docs: int | None = None, n: int = 3, dim: int = DIM) -> DataFrame:
    """The rows whose text is in a learned language: those of ``und`` and those whose score is not above
    the floor of their size class go.

    Languages and floors are learned from all rows not held out (``max_docs`` bounds those of a language that
    teach it). Every row is scored once, and its score written with it. Null, empty and letterless texts go;
    null and repeated ids and repeated rows are judged one by one; all columns go through, whatever their
    names; an empty table, or one without a language, keeps nothing.
    """
    models = _bundled(training_sample(docs.where(~held_out()), max_docs), n, dim)
    scorer = Scorer(models, n, dim)
    score, size = unused(docs, "score", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.names.index("text")
            for b in slices(iter([whole]), at, 1 << 22):
                _, scores, sizes = zip(*scorer(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], [*b.schema.names, score, size])
        trimmed()

    scored = written(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(size, IntegerType())])), "language-scores")
    floors = score_floors(scored.where(~held_out() & F.col("lang").cast("string").isin(list(models))), score, size)
    floor = F.element_at(F.array(*map(F.lit, floors)), F.col(size) + 1)
    return scored.where((F.col(size) >= 0) & (F.col(score) > F.when(F.col(size) >= 0, floor))).select(*[f"`{c}`" for c in docs.columns])


def op9_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
