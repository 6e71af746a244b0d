"""Words and their CRCs straight from the bytes of Arrow's UTF-8 buffers, many texts at a time.

A byte is classified by one lookup, word boundaries are the differences of neighbouring classes, and the
CRCs of all words advance by a byte a step together. The classes used are unions of ASCII bytes and of all
bytes above 0x7F, so a character of several bytes never falls apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Steps that all words take together; what is left of a longer word goes through zlib's CRC.
STEPS = 256


def crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


TABLE = crc_table()
INITIAL = np.uint32(0xFFFFFFFF)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes in ``ranges`` (both ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def terminated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), each followed by a line end, and where each text begins and the
    last one ends. The line end keeps neighbours apart, as no class of word bytes holds it."""
    text, end, joint = pc.fill_null(texts.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in ("\n", ""))
    ended = pc.binary_join_element_wise(text, end, joint)
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8), at - at[0]


def word_bounds(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of class ``inside`` start and end (the byte after); the last byte is outside."""
    edges = np.flatnonzero(np.diff(inside[data].view(np.int8), prepend=np.int8(0)))
    return edges[0::2], edges[1::2]


def step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return TABLE[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


def advance(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states moved on over ``data[start:end]``, all starts a byte a step."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")  # those still running are the first ones
    state, at, length = crc[order], starts[order], length[order]
    running = len(length) - np.searchsorted(length[::-1], np.arange(min(STEPS, int(length[0]) if len(length) else 0)), "right")
    for j, k in enumerate(running.tolist()):
        state[:k] = step(state[:k], data[at[:k] + j].astype(np.uint32))
    for i in range(int((length > STEPS).sum())):
        state[i] = zlib.crc32(data[at[i] + STEPS : at[i] + length[i]].tobytes(), int(state[i] ^ INITIAL)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words: which words begin a run of so many in one group, and the run's CRC-32 with
    the words joined by a space."""
    first = np.arange(len(starts))
    crc = np.full(len(starts), INITIAL, np.uint32)
    out = []
    for n in range(1, most + 1):
        if n > 1:
            fits = first + n - 1 < len(starts)
            first, crc = first[fits], crc[fits]
            same = group[first + n - 1] == group[first]
            first, crc = first[same], step(crc[same], np.uint32(0x20))
        crc = advance(crc, data, starts[first + n - 1], ends[first + n - 1])
        out.append((first, crc ^ INITIAL))
    return out
