"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model reads the document's words and the
probabilities that the models before it gave. In training those earlier probabilities come from
out-of-fold predictions (each labelled row is scored by a model that did not see its fold), so a later
model meets them as good or bad as they will be on new text. Words are chosen by chi-square on the
labelled sample. All of it runs as Spark ML on the executors; texts never leave them.

The labels table has two 0/1 categories, ``quality`` and ``toxic``; the chain goes from "low quality"
to "toxic". Any list of 0/1 label columns can be chained.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import unused, written

#: Columns that the models read and write on their way: words, features, raw scores, probabilities, predictions.
HELPERS = ["__words", "__x", "__raw", "__p", "__said"]
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def tokens() -> Column:
    """Distinct lower-cased letter runs of a whole text (null: none)."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+"), ""))


def choose_words(rows: DataFrame, categories: list[str], each: int, min_docs: int) -> list[str]:
    """The ``each`` words of largest chi-square for every category, among those in ``min_docs`` rows."""
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in categories]).first()
    counts = rows.select(F.explode("tokens").alias("word"), *categories).groupBy("word").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in categories]).where(F.col("n") >= min_docs)
    counts = written(counts, "words")
    found: set[str] = set()
    for c in categories:
        n, p = float(totals["n"]), float(totals[c] or 0)
        if not 0 < p < n:
            continue
        a, b = F.col(c), F.col("n") - F.col(c)
        chi = F.pow(a * (n - p - b) - b * (p - a), F.lit(2)) * n / (F.col("n") * (n - F.col("n")) * p * (n - p))
        best = counts.where(F.col("n") < n).select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(each)
        found |= {r.word for r in best.collect()}
    return sorted(found)


@dataclass
class ToxicityChain:
    """A learned chain: words, and each category's model or, where a label never varies, its share."""

    words: list[str]
    models: list[tuple[str, LogisticRegressionModel | float]]

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with ``tokens``, none where null) and ``p_<category>`` for each category in order.

        Columns under these names give way, all others go through, whatever their names; rows are scored
        one by one, those without a learned word by the models' base rates; an empty table gives an empty
        result.
        """
        docs = docs.drop(*[f"p_{name}" for name, _ in self.models])
        docs = docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
        helpers = unused(docs, *HELPERS)
        out = _vectors(docs, self.words, helpers[0])
        before: list[str] = []
        for name, model in self.models:
            out = _probability(out, model, before, f"p_{name}", helpers)
            before.append(f"p_{name}")
        return out.drop(helpers[0])


def _vectors(docs: DataFrame, words: list[str], out: str = HELPERS[0]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(words or ["\0"], "tokens", out, binary=True, minTF=0.0).transform(docs)


def _probability(rows: DataFrame, model: LogisticRegressionModel | float, before: list[str], name: str, helpers: list[str] = HELPERS) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    words, x, raw, p, said = helpers
    joined = VectorAssembler(inputCols=[words, *before], outputCol=x).transform(rows)
    model = model.copy().setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(said)
    return model.transform(joined).withColumn(name, vector_to_array(p)[1]).drop(x, raw, p, said)


def _fit(rows: DataFrame, label: str, before: list[str], reg: float) -> LogisticRegressionModel | float:
    n, p = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    if not n or p in (0.0, float(n)):
        return float((p or 0) / n) if n else 0.0
    joined = VectorAssembler(inputCols=["__words", *before], outputCol="__x").transform(rows.withColumn("__y", F.col(label).cast("double")))
    return LogisticRegression(featuresCol="__x", labelCol="__y", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__said", regParam=reg, elasticNetParam=1.0, maxIter=30, standardization=False).fit(joined)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_rows: int = 12_000, folds: int = 3, words: int = 100, min_docs: int = 5, reg: float = 0.001) -> ToxicityChain:
    """Learn a chain from labelled documents.

    ``max_rows`` bounds (in expectation, by a hash of the id) the labelled rows used. Rows with a null
    id or label are left out; of repeated labels the largest counts. Without usable labels every
    probability is 0.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(e).alias(c) for c, e in categories.items()]).na.drop()
    usable = usable.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    share = min(1.0, max_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = written(picked.select("doc_id", "text", *names).repartition(8), "toxicity-sample")
    rows = rows.select(tokens().alias("tokens"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).alias("fold"), *names)
    chosen = choose_words(rows, names, words, min_docs)
    rows = _vectors(rows, chosen).drop("tokens").persist()
    models: list[tuple[str, LogisticRegressionModel | float]] = []
    before: list[str] = []
    try:
        for k, name in enumerate(names):
            models.append((name, _fit(rows, name, before, reg)))
            if k + 1 < len(names):
                parts = [_probability(rows.where(F.col("fold") == f), _fit(rows.where(F.col("fold") != f), name, before, reg), before, f"p_{name}") for f in range(folds)]
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                next_rows = out.persist()
                next_rows.count()
                rows.unpersist()
                rows = next_rows
                before.append(f"p_{name}")
    finally:
        rows.unpersist()
    return ToxicityChain(chosen, models)


def classify(docs: DataFrame, chain: ToxicityChain, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category and ``<last category>`` as a boolean, for every
    row; other columns are dropped. Null and empty texts have no word and get the models' base rates;
    repeated rows are scored one by one; an empty table gives an empty result."""
    scored = chain.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens().alias("tokens")))
    last = chain.models[-1][0]
    return scored.select("doc_id", *[f"p_{c}" for c, _ in chain.models], (F.col(f"p_{last}") >= threshold).alias(last))


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, chain)
