import random
from collections import defaultdict

import pytest

from tracewright.llm import spans as sp

SF = "/root/testdata/sf0.01"
CLOSING = "\"')]}»”’*_"


def cut(text):
    """Sentences as lists of words, by a splitter of its own; long ones are left to ``pieces``."""
    out, open_words, word = [], [], ""

    def end_word(force):
        nonlocal word
        if word:
            open_words.append(word)
            core = word
            while core and not (core[-1].isalnum() or core[-1] == "_" or core[-1] in ".!?"):
                core = core[:-1]
            if core and core[-1] in ".!?":
                force = True
        word = ""
        if force and open_words:
            at = 0
            for e in sp.pieces(open_words):
                out.append(open_words[at:e])
                at = e
            open_words.clear()

    for c in text:
        if c.isspace() or c in "\x1c\x1d\x1e\x1f":
            end_word(c == "\n")
        else:
            word += c
    end_word(True)
    return out


def slow(rows):
    """A list of (n_sentences, n_removed, text) by row; rows in order of id (null last)."""
    split = [cut(t or "") for _, t in rows]
    seen = defaultdict(list)
    for i, x in enumerate(split):
        whole = lambda a, b: b - a >= sp.RUN and sum(map(len, x[a:b])) >= sp.WORDS
        for a in range(len(x)):
            for b in range(a + 1, min(len(x), a + 40) + 1):
                if whole(a, b) and not (whole(a, b - 1) and whole(a + 1, b)):
                    seen[tuple(map(tuple, x[a:b]))].append((i, a, b))
    gone = defaultdict(set)
    for v in seen.values():
        for i, a, b in v[1:]:
            gone[i] |= set(range(a, b))
    out = []
    for i, (_, t) in enumerate(rows):
        at, edges = 0, []
        for words in split[i]:
            for k, w in enumerate(words):
                at = t.index(w, at)
                if k == 0:
                    edges.append(at)
                at += len(w)
        edges.append(len(t or ""))
        text = t if not gone[i] else t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(split[i])) if k not in gone[i])
        out.append((len(split[i]), len(gone[i]), text))
    return out


def run(spark, rows, schema="doc_id long, text string"):
    got = sp.remove_repeated_spans(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_sentences, r.n_removed, r.text or "") for r in got))


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted((i is None, i or 0, n, gone, t or "") for (i, _), (n, gone, t) in zip(rows, slow(rows)))


def test_sentences():
    assert [" ".join(w) for w in sp.sentences(' A b. C!" d\ne?! f.g h')] == ["A b.", 'C!"', "d", "e?!", "f.g h"]
    assert [len(w) for w in sp.sentences("w " * 30)] == [30]
    assert max(len(w) for w in sp.sentences(" ".join(f"w{k}" for k in range(300)))) <= sp.PIECE
    assert sp.sentences(" \n") == []
    text = " A b.  C!\n d"
    assert [text[i:][:1] for i in sp.starts_of(text, sp.sentences(text))] == ["A", "C", "d"]


def test_sentences_as_an_independent_splitter_has_them(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() + [("a.) b! c\n\n d... e?\" f g .",), ("",)]:
        assert sp.sentences(r[0]) == cut(r[0])


def test_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sp.op6_sentence_spans(spark, SF).collect()}
    assert got == {i: x for (i, _), x in zip(rows, slow(rows))}
    assert sum(n for _, n, _ in got.values()) > 100


PASSAGE = " ".join(f"Word{i} tells of thing{i} and more{i}." for i in range(12))


def test_planted_passage_and_odd_rows(spark):
    rows = [(1, "Lead one. " + PASSAGE + " Tail one."), (2, "Other lead here. " + PASSAGE + " Other tail."), (3, None), (4, ""), (5, PASSAGE + "\n" + PASSAGE), (6, "Clean text. It says new things. None of it is repeated here."), (8, "x. " * 4000)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2, [3]) for i, t in rows], "doc_id long, text string, n_removed string, row int, marks int, h array<int>")
    out = sp.remove_repeated_spans(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "n_sentences"])
    got = {r.doc_id: r for r in out.collect()}
    assert [(r.n_sentences, r.n_removed, r.text) for _, r in sorted(got.items())] == slow(rows)
    assert got[1].text == rows[0][1] and got[2].text == "Other lead here. Other tail." and got[5].text.strip() == "" and got[6].n_removed == 0
    assert got[1].row == 1 and got[1].marks == 2 and got[1].h == [3]
    twice = sp.remove_repeated_spans(docs.unionByName(docs)).collect()
    assert len(twice) == 14 and sorted(r.text for r in twice if r.doc_id == 1) == ["", rows[0][1]] and all(r.h == [3] for r in twice)
    assert sp.remove_repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "rows",
    [
        [(0, PASSAGE), (1, PASSAGE), (1, "short one.")],
        [(0, PASSAGE), (1, PASSAGE), (1, None)],
        [(0, PASSAGE), (1, PASSAGE), (1, " ".join(f"Another{i} says nothing{i} at{i} all{i}." for i in range(12)))],
        [(None, PASSAGE), (None, PASSAGE), (None, PASSAGE), (None, None), (7, "So it is.")],
    ],
)
def test_repeated_and_null_ids(spark, rows):
    assert run(spark, rows) == want(rows)


def test_punctuated_passage_of_over_50_words_is_caught(spark):
    """Passages of sentences of 8 to 25 words between sentences of other texts; share of their words that goes."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    sentence = lambda: " ".join(word() for _ in range(rng.randint(8, 25))) + "."
    rows, planted = [], []
    for k in range(40):
        passage = []
        while sum(len(s.split()) for s in passage) <= 50:
            passage.append(sentence())
        planted.append(" ".join(passage).split())
        rows += [(2 * k + j, " ".join([sentence() for _ in range(rng.randint(0, 4))] + passage + [sentence() for _ in range(3)])) for j in (0, 1)]
    left = {r.doc_id: set(r.text.split()) for r in sp.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(p) <= left[2 * k] for k, p in enumerate(planted))
    shares = [1 - len(left[2 * k + 1] & set(p)) / len(set(p)) for k, p in enumerate(planted)]
    assert sum(s >= 0.9 for s in shares) >= 0.9 * len(shares), shares
