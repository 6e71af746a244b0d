"""Exact token counts of a byte-level BPE by finite-state transducers.

Two deterministic machines replace the tokenizer:

* The *splitter* reads character classes and marks where pre-tokens start. It has eight states. A
  block of text is cut in equal chunks; for each chunk, the map "state before -> state after, number
  of pre-tokens emitted" is worked out for all states at once, the maps compose in a parallel prefix
  scan, and with each chunk's true entry state known a second sweep marks the starts. Chunks may
  cut words anywhere.
* The *merger* reads the bytes of a pre-token. Its transitions carry the number of tokens emitted
  (negative where a merge takes one back). It is the determinised subset automaton of BPE: a state
  holds, for each start of a vocabulary entry still being read, the place in the vocabulary trie, the
  token that ends before that start and the count there. The last token of a prefix is the only
  entry that forms a stable pair with the token before it (two tokens are stable side by side if
  BPE gives just these two for their joined bytes). States are compiled when first met.

Counts come out of composed chunk maps on both levels. A long pre-token is cut in chunks of bytes; each
chunk's map "state before -> state after, tokens emitted" is first worked out for the state that the
chunk before leads to by itself, which is mostly the true one, then for those it is still asked for, and
the maps compose in a prefix scan. Between pre-tokens the merger is in its start state, so the map of a
chunk of pre-tokens is one state and a number of tokens; these compose in the same scan, and a text's
count is the difference of the scan's totals at its two ends.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm.common import held, slices, trimmed

# Character classes of the table, then the symbols that depend on what follows.
LETTER, NUMBER, OTHER, BLANK, WHITE, END, BLANK_LAST, WHITE_LAST, SHORT_TWO, SHORT_THREE = range(10)
UNKNOWN = 255
# Splitter states: nothing open; in letters, numbers, others; after a blank that joins the next run;
# in white space; one letter, two letters of a contraction to go.
FRESH, IN_L, IN_N, IN_O, JOIN, IN_W, ONE_LEFT, TWO_LEFT = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark for each state and symbol."""
    go, mark = np.zeros((8, 10), np.uint8), np.ones((8, 10), np.uint8)
    for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        go[:, symbol] = run
        mark[[run, JOIN], symbol] = 0
    go[ONE_LEFT, :3], mark[ONE_LEFT, :3] = FRESH, 0
    go[TWO_LEFT, :3], mark[TWO_LEFT, :3] = ONE_LEFT, 0
    for symbol, to in ((SHORT_TWO, ONE_LEFT), (SHORT_THREE, TWO_LEFT)):
        go[:, symbol] = to
        go[[IN_O, JOIN], symbol], mark[[IN_O, JOIN], symbol] = IN_O, 0
    for symbol in (BLANK, WHITE):
        go[:, symbol] = IN_W
        mark[IN_W, symbol] = 0
    go[:, BLANK_LAST], go[:, WHITE_LAST], go[:, END] = JOIN, FRESH, FRESH
    return go, mark


class Splitter:
    """Pre-token starts for a tokenizer with the byte-level regular expression."""

    CHUNK, TAIL = 512, 64

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.pieces_of = tokenizer.pre_tokenizer.pre_tokenize_str
        self.go, self.mark = _splitter()
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(128):
            self.table[c] = self._class(chr(c))

    def _class(self, c: str) -> int:
        """Ask the tokenizer itself, so that its Unicode tables hold."""
        alone = lambda s: len(self.pieces_of(s)) == 1
        if c == " ":
            return BLANK
        return LETTER if alone("a" + c) else NUMBER if alone("1" + c) else OTHER if alone("!" + c) else WHITE

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Splitter input for code points; ``ends``: places of the separators between texts."""
        kind = self.table[points]
        if (kind == UNKNOWN).any():
            for p in np.unique(points[kind == UNKNOWN]):
                self.table[p] = self._class(chr(p))
            kind = self.table[points]
        kind[ends] = END
        nxt = np.append(kind[1:], END)
        solid = nxt < BLANK
        kind[(kind == BLANK) & solid] = BLANK_LAST
        kind[(kind == WHITE) & solid] = WHITE_LAST
        at = np.flatnonzero(points[:-1] == 39)
        if len(at):
            at = at[(kind[at] == OTHER)]
            one = points[at + 1]
            two = points[np.minimum(at + 2, len(points) - 1)]
            kind[at[np.isin(one, [115, 116, 109, 100])]] = SHORT_TWO
            three = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            kind[at[three]] = SHORT_THREE
        return kind

    def chunk_maps(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chunks (columns) of symbols: state after and starts emitted, by state before."""
        state = np.tile(np.arange(8, dtype=np.int64), (sym.shape[1], 1))
        emitted = np.zeros(state.shape, np.int32)
        go, mark = self.go.ravel().astype(np.int64), self.mark.ravel()
        for k, row in enumerate(sym):
            if k % 16 == 15 and (state == state[:, :1]).all():
                break  # every map is constant by now: one state a chunk suffices for the rest
            at = state * 10 + row[:, None]
            emitted += mark[at]
            state = go[at]
        else:
            return state, emitted
        one, more = state[:, 0], np.zeros(len(state), np.int32)
        for row in sym[k:]:
            at = one * 10 + row
            more += mark[at]
            one = go[at]
        return np.repeat(one[:, None], 8, 1), emitted + more[:, None]

    @staticmethod
    def scan(state: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix products of the chunk maps: row k maps from before chunk 0 to after chunk k."""
        step = 1
        while step < len(state):
            first, n1 = state[:-step], emitted[:-step]
            n2 = n1 + np.take_along_axis(emitted[step:], first, 1)
            then = np.take_along_axis(state[step:], first, 1)
            state, emitted = np.concatenate([state[:step], then]), np.concatenate([emitted[:step], n2])
            step *= 2
        return state, emitted

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places where pre-tokens start (each separator counts as one)."""
        sym = self.symbols(points, ends)
        n, size = len(sym), self.CHUNK
        chunks = -(-n // size)
        sym = np.ascontiguousarray(np.append(sym, np.full(chunks * size - n, END, np.uint8)).reshape(chunks, size).T)
        now = np.zeros(chunks, np.int64)
        if chunks > 1:
            state, emitted = self.chunk_maps(sym[-self.TAIL :])  # a constant map of a chunk's end is the chunk's map
            if (state != state[:, :1]).any():
                state, emitted = self.chunk_maps(sym)
            state, _ = self.scan(state, emitted)
            now[1:] = state[:-1, FRESH]
        marks = np.empty(sym.shape, np.uint8)
        go, mark = self.go.ravel().astype(np.int64), self.mark.ravel()
        for k, row in enumerate(sym):
            at = now * 10 + row
            marks[k] = mark[at]
            now = go[at]
        return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])

    def _cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts joined, a separator behind each; its code points; the separators' places; the starts."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        return joined, points, ends, self.starts(points, ends)

    def piece_array(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Pre-tokens of the texts in order, an empty string behind those of each text, and these strings' places.

        All share one Arrow buffer, so a pre-token costs no Python object.
        """
        if not texts:
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        _, points, ends, at = self._cut(texts)
        width = np.ones(len(points), np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        width[ends] = 0  # the buffer has no separators
        edges = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(at, len(points))]
        buffers = [None, pa.py_buffer(edges), pa.py_buffer("".join(texts).encode())]
        return pa.Array.from_buffers(pa.large_string(), len(at), buffers), np.searchsorted(at, ends)

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of the texts in order, and how many each text has."""
        if not texts:
            return [], np.zeros(0, np.int64)
        joined, _, ends, at = self._cut(texts)
        where = at.tolist()
        where.append(len(joined))
        out = [joined[a:b] for a, b in zip(where, where[1:])]
        index = np.searchsorted(at, ends)
        n = np.diff(index, prepend=-1) - 1
        for k in index[::-1].tolist():  # the separators
            out[k] = ""
        return [p for p in out if p], n


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The lazily compiled transducer from a pre-token's bytes to its number of tokens."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        of = byte_characters()
        self.ids = {bytes(of[c] for c in w): i for w, i in model["vocab"].items() if all(c in of for c in w)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, tuple[int, int]]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        for r, m in enumerate(model["merges"]):
            a, b = (bytes(of[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = (self.ids[a], self.ids[b])
            self.rank[pair] = r
            self.made_of.setdefault(self.ids[a + b], (r, pair))
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for w, i in self.ids.items():
            at = 0
            for b in w:
                to = self.trie[at].get(b)
                if to is None:
                    to = self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                at = to
            self.token_at[at] = i
        self.most = most
        self.stable: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((), -1)
        self.states, self.number = [start], {start: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at the right (1) or left (0) edge while ``token`` is being merged,
        each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, taken = [], math.inf
            while True:
                known.append((token, taken))
                if token not in self.made_of:
                    break
                taken, pair = self.made_of[token]
                token = pair[side]
            known.reverse()
            self.edges[side][known[-1][0]] = known
        return known

    def _stable(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens side by side: no pair across their border may merge
        before one of its two sides is taken up by a merge of its own (the left one goes first)."""
        key = a << 20 | b
        known = self.stable.get(key)
        if known is not None:
            return known
        if len(self.stable) >= self.most:
            self.stable.clear()
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        known = True
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            r = self.rank.get((x, y), math.inf)
            if r < x_taken and r <= y_taken and r < math.inf:
                known = False
                break
            if x_taken == y_taken == math.inf:
                break
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1
        self.stable[key] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The arc of one state on one byte: next state and tokens emitted."""
        open_starts, last = self.states[state]
        emitted, token, kept = None, -1, []
        for node, before, rel in (*open_starts, (0, last, 0)):
            to = self.trie[node].get(byte)
            if to is None:
                continue
            t = self.token_at[to]
            if t >= 0 and emitted is None and (before < 0 or self._stable(before, t)):
                emitted, token = rel + 1, t
            if self.trie[to]:
                kept.append((to, before, rel))
        new = (tuple((n, b, r - emitted) for n, b, r in kept), token)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        arc = self.arcs[state << 8 | byte] = (to, emitted)
        return arc

    def count(self, word: bytes) -> int:
        """Tokens of a whole pre-token: the emission of its composed chunk maps from the start state."""
        if len(self.arcs) > self.most:
            self._reset()
        if len(word) <= self.CHUNK:
            return self.run(word, 0)[1]
        return self.scan(self.chunk_maps(word))[-1][0][1]


    CHUNK = 256

    def chunk_maps(self, word: bytes) -> list[dict[int, tuple[int, int]]]:
        """For each chunk of bytes: state after and tokens emitted, by state before, for all states
        before that the maps of the chunk before lead to."""
        chunks = [word[a : a + self.CHUNK] for a in range(0, len(word), self.CHUNK)]
        maps: list[dict[int, tuple[int, int]]] = [{0: self.run(c, 0)} for c in chunks]
        for k in range(1, len(chunks)):
            for state, _ in list(maps[k - 1].values()):
                if state not in maps[k]:
                    maps[k][state] = self.run(chunks[k], state)
        return maps

    @staticmethod
    def scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
        """Prefix products: map k leads from before chunk 0 to after chunk k."""
        step = 1
        while step < len(maps):
            then = [{s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items()} for a, b in zip(maps, maps[step:])]
            maps = maps[:step] + then
            step *= 2
        return maps

    def run(self, part: bytes, state: int) -> tuple[int, int]:
        """State after some bytes, and tokens emitted."""
        arcs, total = self.arcs, 0
        for b in part:
            arc = arcs.get(state << 8 | b) or self._compile(state, b)
            state = arc[0]
            total += arc[1]
        return state, total


class Counts(dict):
    """Token counts by pre-token; at most ``most`` are remembered."""

    def __init__(self, merger: Merger, most: int = 300_000) -> None:
        super().__init__()
        self.merger, self.most = merger, most

    def __missing__(self, piece: str) -> int:
        n = self.merger.count(piece.encode())
        if len(self) < self.most and len(piece) < 64:
            self[piece] = n
        return n


class TokenCounter:
    """Numbers of tokens exactly as the tokenizer file gives them."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
        self.splitter = Splitter(tokenizer)
        self.counts = Counts(Merger(path))

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """One per worker process."""
        return held((cls, path), lambda: cls(path))

    @staticmethod
    def totals(emitted: np.ndarray) -> np.ndarray:
        """Tokens before each pre-token and after the last, by the scan of the chunks' one-state maps."""
        n, size = len(emitted), Splitter.CHUNK
        chunks = max(1, -(-n // size))
        inner = np.cumsum(np.append(emitted, np.zeros(chunks * size - n, np.int64)).reshape(chunks, size), axis=1)
        _, after = Splitter.scan(np.zeros((chunks, 1), np.int64), inner[:, -1:])
        inner[1:] += after[:-1]
        return np.append(0, inner.ravel()[:n])

    def count(self, texts: list[str]) -> np.ndarray:
        parts: list[str] = []
        owner, total = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            cut = [t]
            for s in self.special:
                if s in t:
                    cut = [y for x in cut for y in x.split(s)]
            total[i] += len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        pieces, n = self.splitter.pieces(parts)
        upto = self.totals(np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces)))
        edge = np.concatenate([[0], np.cumsum(n)])
        np.add.at(total, np.array(owner, np.int64), upto[edge[1:]] - upto[edge[:-1]])
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 1024, slice_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; other columns are dropped.

    ``path`` is a byte-level BPE tokenizer file with the usual splitting expression. A null text
    counts as empty (no byte, no token); special strings in a text are single tokens, the library's
    default; repeated rows are counted one by one; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(path)
        for b in slices(batches, 1, slice_bytes):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counter.count(b.column(1).to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])
        trimmed()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
