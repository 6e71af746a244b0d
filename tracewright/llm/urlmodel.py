"""URL filters: rules on host and path, and for the rest the ratio of two character language models.

The rules' own verdicts are the labels: one smoothed variable-order Markov model is counted from the URLs
that rules allow, one from those that rules block. A URL is judged by the difference of its
log-likelihoods under both, divided by its number of characters, against a threshold calibrated on a part
of the labelled URLs that the models have not seen.

Characters are folded to 40 symbols, so n-grams are numbers. Spark counts the n-grams of all labelled URLs;
a context of ``k`` symbols is kept only if it makes up at least one in ``contexts`` of all characters
counted, so at most ``contexts`` of each length are kept whatever the input, and a longer context is used
where it is kept (variable order). Only the kept contexts' counts reach the driver and, as two smoothed
tables' difference, the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewright.llm import bytewords as B
from tracewright.llm.common import slices, trimmed, unused, written

SYMBOLS, ORDER = 40, 5
EDGE, OTHER, WIDE, DIGIT = 39, 37, 38, 26
CONTEXTS = 4096
HELD_OUT = 5
SLICE = 1 << 20
#: Scores are counted in cells of this width for the calibration, within plus and minus ``REACH``.
CELL, REACH = 1 / 256, 8.0
MAX_RULES = 1000
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def symbol_table() -> np.ndarray:
    """Letters whatever their case, one symbol for all digits, the marks of URLs, other ASCII, bytes above ASCII."""
    t = np.full(256, OTHER, np.int64)
    t[128:] = WIDE
    for i in range(26):
        t[65 + i] = t[97 + i] = i
    t[48:58] = DIGIT
    for i, c in enumerate("./-_?=&%#:"):
        t[ord(c)] = DIGIT + 1 + i
    t[0] = EDGE
    return t


SYMBOL = symbol_table()
assert SYMBOL.max() < SYMBOLS


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first given), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most are tried one by one")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last one that fits decides
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def transitions(urls: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every character of every URL, and its end: the URL's number, the symbol, and for ``k`` up to
    ``order`` the number of the ``k`` symbols before it (edges before the first)."""
    text = pc.replace_substring(pc.fill_null(urls, ""), "\x00", "\x01").cast(pa.large_string())
    edge = lambda s: pa.scalar(s, pa.large_string())
    padded = pc.binary_join_element_wise(edge("\x00" * order), text, edge("\x00"), edge(""))
    _, offsets, data = padded.buffers()
    at = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1]
    symbols = SYMBOL[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if len(urls) else np.empty(0, np.int64)
    at = at - at[0] if len(urls) else np.zeros(1, np.int64)
    length = np.diff(at) - order
    first = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(first[-1]) + np.repeat(at[:-1] + order - first[:-1], length)
    contexts, code = [np.zeros(len(place), np.int64)], np.zeros(len(place), np.int64)
    for k in range(1, order + 1):
        code = code + symbols[place - k] * SYMBOLS ** (k - 1)
        contexts.append(code)
    return np.repeat(np.arange(len(urls)), length), symbols[place], contexts


@dataclass
class UrlModel:
    """Kept contexts of each length, ascending, with the log ratio of every next symbol after each; and the
    score from which a URL is allowed."""

    keys: list[np.ndarray]
    ratios: list[np.ndarray]
    cut: float = 0.0
    counted: dict[str, int] = field(default_factory=dict)

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Mean log-likelihood ratio of each URL's characters and its end."""
        of, symbol, contexts = transitions(urls, len(self.keys) - 1)
        ratio = np.zeros(len(symbol))
        for keys, table, context in zip(self.keys, self.ratios, contexts):
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            ratio = np.where(keys[at] == context, table[at, symbol], ratio)
        return np.bincount(of, ratio, len(urls)) / np.maximum(np.bincount(of, minlength=len(urls)), 1)

    def scored(self, pages: DataFrame, text: str, score: str) -> DataFrame:
        """``pages`` with column ``score`` of the URLs in column ``text``."""
        at, names, scores = pages.columns.index(text), [*pages.columns, score], self.scores

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, at, SLICE):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column(at)))], names)
            trimmed()

        return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(score, DoubleType())]))


def gram_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``k, context, symbol, allowed, blocked``: how often each symbol follows each context of ``k`` symbols
    in ``text, verdict``. Tasks count the longest contexts; the shorter ones are sums of those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, SLICE):
            of, symbol, contexts = transitions(b.column(0), order)
            allowed = pc.equal(b.column(1), "allow").to_numpy(zero_copy_only=False)[of]
            code, n = np.unique((contexts[order] * SYMBOLS + symbol) * 2 + allowed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code >> 1), pa.array(n * (code & 1)), pa.array(n * (1 - (code & 1)))], ["gram", "allowed", "blocked"])
        trimmed()

    long = urls.select("text", "verdict").mapInArrow(count, "gram long, allowed long, blocked long")
    sums = [F.sum(c).alias(c) for c in ("allowed", "blocked")]
    long = long.groupBy("gram").agg(*sums)
    widths = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(SYMBOLS**k).cast("long").alias("w")) for k in range(order + 1)])
    each = long.select(F.explode(widths).alias("x"), "gram", "allowed", "blocked")
    cells = each.select("x.k", (F.expr(f"gram div {SYMBOLS}") % F.col("x.w")).alias("context"), (F.col("gram") % SYMBOLS).alias("symbol"), "allowed", "blocked")
    return cells.groupBy("k", "context", "symbol").agg(*sums)


def smoothed(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities of every symbol after each kept context (Witten-Bell): a context's counts plus as many
    times the next shorter context's probabilities as different symbols followed it."""
    out: list[np.ndarray] = []
    for k, n in enumerate(counts):
        if k:
            up = out[-1][np.searchsorted(keys[k - 1], keys[k] % SYMBOLS ** (k - 1))]
        else:
            up = np.full((len(n), SYMBOLS), 1 / SYMBOLS)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        out.append(np.where(total > 0, (n + kinds * up) / np.maximum(total + kinds, 1), up))
    return out


def markov_ratio(urls: DataFrame, order: int = ORDER, contexts: int = CONTEXTS) -> UrlModel:
    """The model of ``text, verdict`` (``allow`` or ``block``), uncalibrated. Without URLs of both verdicts
    every ratio is 0."""
    cells = written(gram_counts(urls, order), "url-grams")
    allowed, blocked = (n or 0 for n in cells.where("k = 0").agg(F.sum("allowed"), F.sum("blocked")).first())
    counted = {"allowed": allowed, "blocked": blocked}
    if not allowed or not blocked:
        return UrlModel([np.empty(0, np.int64)] * (order + 1), [np.empty((0, SYMBOLS))] * (order + 1), counted=counted)
    least = (allowed + blocked) / contexts
    kept = cells.groupBy("k", "context").agg(F.sum(F.col("allowed") + F.col("blocked")).alias("total")).where((F.col("k") == 0) | ((F.col("total") >= least) & (F.col("total") > 1)))
    rows = cells.join(kept.select("k", "context"), ["k", "context"]).toArrow()  # (order * contexts + 1) * SYMBOLS rows at most
    k, context, symbol, a, b = (rows.column(c).to_numpy() for c in ("k", "context", "symbol", "allowed", "blocked"))
    keys, of_a, of_b = [], [], []
    for i in range(order + 1):
        mine = k == i
        keys.append(np.unique(context[mine]))
        at = np.searchsorted(keys[-1], context[mine])
        for out, n in ((of_a, a), (of_b, b)):
            table = np.zeros((len(keys[-1]), SYMBOLS))
            table[at, symbol[mine]] = n[mine]
            out.append(table)
    ratios = [np.log(x) - np.log(y) for x, y in zip(smoothed(keys, of_a), smoothed(keys, of_b))]
    return UrlModel(keys, ratios, counted=counted)


def calibrated(model: UrlModel, urls: DataFrame) -> UrlModel:
    """``model`` with the score that best parts allowed from blocked ``urls``: the share of allowed ones at
    or above it plus the share of blocked ones below is greatest (of equally good ones the one nearest to 0).
    Scores are counted in cells, a bounded table. Without URLs of both verdicts it is 0."""
    scored = model.scored(urls.select("text", "verdict"), "text", "score")
    cell = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("score"))) / CELL).cast("long")
    counts = scored.groupBy(cell.alias("cell")).agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")).collect()
    allowed, blocked = sum(r.allowed for r in counts), sum(r.blocked for r in counts)
    model.cut = 0.0
    if allowed and blocked:
        by_cell = {r.cell: r for r in counts}
        above, under, best = allowed, 0, None
        low, high = min(0, *by_cell), max(0, *by_cell) + 1
        for c in range(low, high + 1):
            gain = above * blocked + under * allowed
            if best is None or (gain, -abs(c)) > best[0]:
                best = ((gain, -abs(c)), c)
            if c in by_cell:
                above, under = above - by_cell[c].allowed, under + by_cell[c].blocked
        model.cut = best[1] * CELL
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER, contexts: int = CONTEXTS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``.

    ``rules`` are pairs of verdict and ``host/path``: one fits its host and all subdomains if the path
    starts with the rule's; the longest that fits decides. Other URLs are allowed if ``score``, their mean
    log-likelihood ratio, is at least the calibrated cut. A null URL is judged as an empty text, one
    without ``://`` as a whole, both with empty host and path. Rows are judged one by one, whatever their
    ids; an empty table gives an empty result; columns under the new names give way.
    """
    added = ("host", "path", "rule", "verdict", "score")
    names = [c for c in pages.columns if c not in added]
    text, decided = unused(pages, "text_", "decided_")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(*names, host.alias("host"), path.alias("path"), F.coalesce(after_scheme(url), url).alias(text))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, decided: verdict})
    labelled = rows.where(F.col(decided).isNotNull()).select(F.col(text).alias("text"), F.col(decided).alias("verdict"))
    unseen = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    model = calibrated(markov_ratio(labelled.where(~unseen), order, contexts), labelled.where(unseen))
    judged = F.when(F.col("score") >= F.lit(model.cut), F.lit("allow")).otherwise(F.lit("block"))
    out = model.scored(rows, text, "score").withColumn("verdict", F.coalesce(F.col(decided), judged))
    return out.select(*names, *added)


def op13_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
