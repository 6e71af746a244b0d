"""Quality rules as a learned decision list, native from end to end.

Statistics of every whole text come from built-in array and string functions. Sequential covering
then learns from the labelled documents' statistics: a rule is grown as a conjunction of thresholds
by FOIL gain, pruned on held-back rows, accepted if it is precise there, and the rows it covers are
removed before the next rule is grown. The list is emitted as one ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once and held in a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the array."""
    hashed = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def positions(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: F.get(pairs, k - 1)["v"].eqNullSafe(x["v"]) | F.get(pairs, k + 1)["v"].eqNullSafe(x["v"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, positions))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashed, count))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``COUNTS`` (longs) for every row; other columns are dropped.

    A null text counts as empty; every count of an empty or blank text is zero.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda t, chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    words = F.array_remove(F.split(text, SPACE), "")
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without(text, SYMBOLS).alias("n_symbols"),
        without(text, UPPER).alias("n_upper"),
        without(text, "!").alias("n_exclaim"),
        without(text, "0123456789").alias("n_digits"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_exclaim", "n_digits")


#: What conditions may test, by name, as SQL over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cut_points(values: np.ndarray, cuts: int) -> np.ndarray:
    """Midpoints above quantiles of the rows and of the distinct values."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return distinct[:0]
    shares = np.linspace(0, 1, cuts + 2)[1:-1]
    at = np.concatenate([np.searchsorted(distinct, np.quantile(values, shares, method="lower")), (shares * (len(distinct) - 1)).astype(int)])
    at = np.unique(np.minimum(at, len(distinct) - 2))
    return (distinct[at] + distinct[at + 1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        before, best, best_gain = math.log2(p / (p + n)), None, 0.0
        for f, values in x.items():
            for t in _cut_points(values[inside], cuts):
                for above in (True, False):
                    hit = inside & ((values > t) if above else (values <= t))
                    p1 = int((bad & hit).sum())
                    if not p1 or hit.sum() == inside.sum():
                        continue
                    gain = p1 * (math.log2(p1 / int(hit.sum())) - before)
                    if gain > best_gain + 1e-9:
                        best, best_gain = Condition(f, above, float(t)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, min_precision: float = 0.9, min_support: int = 5, cuts: int = 40, longest: int = 4, most: int = 20) -> list[Rule]:
    """The ordered rules for rejecting; ``held`` marks the rows kept back for pruning.

    Learning ends with the first rule that is not precise on the held rows, at the latest after ``most``
    rules, of ``longest`` conditions at most: bounds of the learned list, not of the rows it judges.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most:
        g, h = left & ~held, left & held
        gx, hx = ({f: v[m] for f, v in x.items()} for m in (g, h))
        if not bad[g].any():
            break
        rule = _grow(gx, bad[g], cuts, longest)
        worth = lambda r: (lambda c: (2 * float(bad[h][c].mean()) - 1) if c.any() else -1.0)(_covers(r, hx, int(h.sum())))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, hx, int(h.sum()))
        if not rule or c.sum() < min_support or bad[h][c].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, **settings) -> list[Rule]:
    """Learn the list from labelled documents.

    ``max_rows`` bounds (in expectation, by a hash of ``doc_id``) the labelled rows used; their
    statistics, a few numbers a row, go to the driver. Null labels and ids are left out; of repeated
    labels the lowest counts. Without usable labels the list is empty.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    n = usable.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = usable.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = (
        text_statistics(picked).join(F.broadcast(sample), "doc_id")
        .select("doc_id", base_failed().alias("failed"), (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0).alias("held"), *[F.expr(v).alias(k) for k, v in FEATURES.items()])
        .collect()
    )
    rows = sorted((r for r in rows if not r.failed), key=lambda r: r.doc_id)  # here, as a filter or sort in the plan would compute the statistics of all rows
    x = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn(x, np.array([r.bad for r in rows], bool), np.array([r.held for r in rows], bool), **settings)


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """All counts of every row with ``base_failed`` and ``kept``.

    Null, empty and blank texts have no word and fail the base rules; repeated rows are judged one
    by one; an empty table gives an empty result.
    """
    rules = fit(docs, labels, **settings)
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_exclaim", "n_digits")
