import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tracewright.llm import phrases as P

SF = "/root/testdata/sf0.01"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, min_n=2, max_n=4, least=30, top=2000, percent=80, scale=2_000_000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) >= min_n and a >= least}
    gone = set()
    for (lang, g), a in cand.items():
        for size in range(min_n, len(g)):
            for i in range(len(g) - size + 1):
                part = (lang, g[i : i + size])
                if 100 * a >= percent * f[part]:
                    gone.add(part)
    rows = []
    for (lang, g), a in cand.items():
        if (lang, g) not in gone:
            score, _, l, r = min((scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            rows.append((lang, -score, -a, " ".join(g).encode(), l, r))
    out, place = [], Counter()
    for lang, score, a, g, l, r in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], g.decode(), -a, l, r, total[lang], -score))
    return out


def test_query_against_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r[n] for n in NAMES) for r in P.op12_suffix_sigma(spark, SF).collect())
    assert got == sorted(slow(docs)) and len(got) > 200
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(f"SELECT {', '.join(NAMES)} FROM ({P.OP12_SQL})").fetchall()) == got


def odd_docs():
    r = random.Random(3)
    words = ["a", "b", "a\x01", "a\x00", "\x00", "\x01\x00b", "É", "ça", "the", "\x02x"]
    docs = [(r.choice(["en", "de", None, "x\x01", ""]), r.choice([" ", "\t ", "  "]).join(r.choice(words) + r.choice(["", "", "", ".", ",\n", "\x0b"]) for _ in range(r.randrange(40)))) for _ in range(300)]
    return docs + [("en", None), (None, None), ("en", ""), ("de", ".. ,"), ("en", "The The THE the " * 2000), *[("en", "a b the a b the É x")] * 50]


@pytest.mark.parametrize("buffer,partition", [(1 << 12, 1 << 10), (P.BUFFER, P.PARTITION)])
def test_odd_rows_small_buffers_and_many_partitions(spark, monkeypatch, buffer, partition):
    monkeypatch.setattr(P, "BUFFER", buffer)
    monkeypatch.setattr(P, "PARTITION", partition)
    docs = odd_docs()
    df = spark.createDataFrame([(i % 5, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    for least, top, max_n in ((3, 50, 4), (1, 2000, 3)):
        got = P.collocations(df, max_n=max_n, least=least, top=top)
        assert got.columns == NAMES
        assert sorted(map(tuple, got.collect())) == sorted(slow(docs, least=least, top=top, max_n=max_n))


def test_counts_of_every_prefix_in_any_batches(monkeypatch):
    """The stack's counts, summed over tasks cut anywhere, equal a plain count."""
    monkeypatch.setattr(P, "trimmed", lambda: None)
    r = random.Random(5)
    rows = sorted(((r.choice("de"), "".join(r.choice(["a", "b", "bb", "c"]) + P.END for _ in range(r.randrange(1, 5))), r.randrange(1, 4)) for _ in range(400)), reverse=True)
    want = Counter()
    for lang, key, n in rows:
        words = key.split(P.END)[:-1]
        for d in range(len(words) + 1):
            want[lang, "".join(w + P.END for w in words[:d])] += n
    for task, batch in ((400, 400), (400, 1), (37, 5), (1, 1), (90, 7)):
        for least in (1, 25):
            got = Counter()
            for i in range(0, 400, task):
                part = rows[i : i + task]
                batches = (pa.RecordBatch.from_arrays([pa.array([x[0] for x in b]), pa.array([x[1] for x in b]), pa.array([x[2] for x in b], pa.int64())], ["lang", "key", "n"]) for b in (part[j : j + batch] for j in range(0, len(part), batch)))
                for out in P.prefix_counts(batches, 4, least):
                    for x in out.to_pylist():
                        got[x["lang"], x["phrase"]] += x["n"]
            assert {k: n for k, n in got.items() if n >= least} == {k: n for k, n in want.items() if n >= least}


def test_empty_table_and_wide_numbers(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert P.collocations(none).count() == 0
    df = spark.createDataFrame([(1, "en", "x y. " * 40)], "doc_id long, lang string, text string")
    row = P.collocations(df, scale=10**18).first()
    assert (row.a, row.l, row.r, row.score) == (40, 40, 40, 10**18 // 2)


def test_a_frequent_word_is_cut_over_partitions(spark):
    """A third of all suffixes begin with one word; its suffixes lie in several of the bounds' ranges."""
    docs = spark.range(3000).selectExpr("'en' AS lang", "concat('the ', id % 97, ' ', id % 89, ' ', id % 83, '. w', id, ' v', id) AS text")
    bounds = P.range_bounds(docs, 24, 3000, 4)
    assert sum(key.startswith(b"the\x00") for _, key in bounds) >= 2
