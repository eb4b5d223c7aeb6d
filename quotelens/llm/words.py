"""Words of many texts at once, as arrays of numbers.

A word is a run of bytes other than space and \\x09 to \\x0D. Texts are handled in blocks of a few MB, whatever the size
of an Arrow batch; one text is never cut. Within a block a word has a number of its own, so that equality there is exact;
between blocks it has a 128-bit hash of its bytes. Runs of words are numbered, or hashed, by their halves: a run of 2n
words is a pair of runs of n, so there is no arithmetic between words that regular sequences could cancel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 250_000
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread each value over 64 bits, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _by_halves(values: np.ndarray, n: int, pair: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """pair() folded over each run of n values, in an order that depends on n alone."""
    out, done, power, size = None, 0, values, 1
    while True:
        if n & size:
            part = power[done:]
            out = part if out is None else pair(out[: len(part)], part)
            done += size
        if 2 * size > n:
            return out
        power = pair(power[:-size], power[size:])
        size *= 2


def hashes_of_runs(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n hashes; equal runs have equal hashes wherever they lie."""
    if len(values) < n:
        return np.zeros(0, dtype=_U)
    return _by_halves(values, n, lambda a, b: mix64(a * _U(0x9E3779B97F4A7C15) + b))


def number(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal for equal values only."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def numbers_of_runs(values: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n numbers, equal for equal runs only."""
    if len(values) < n:
        return np.zeros(0, dtype=np.int64)
    return _by_halves(values, n, lambda a, b: number(a * (b.max() + 1) + b) if len(b) else b)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings of the given lengths that follow one another in data."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Block:
    """Texts rows[0]..rows[1] of a batch. word_start and word_end: bytes in data; first: the first word of each text, and the end.

    word: a number for each word, equal for equal words of the block only; known: the words by their number.
    """

    rows: tuple[int, int]
    data: np.ndarray
    text_start: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    word: np.ndarray
    known: pa.Array
    first: np.ndarray

    @cached_property
    def word_hash(self) -> np.ndarray:
        """Two 64-bit hashes of each word's bytes, in columns."""
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.known.to_pylist())), dtype="<u8").reshape(-1, 2).astype(_U)
        return hashes[self.word]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def places(self, n: int) -> np.ndarray:
        """The first word of each run of n words within one text."""
        counts = np.maximum(np.diff(self.first) - n + 1, 0)
        return np.repeat(self.first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def words_of(self, i: int) -> list[bytes]:
        return self.data[self.text_start[i] : self.text_start[i + 1]].tobytes().split()


def blocks(texts: pa.Array, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """texts: strings; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        data, text_start = everything[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            data = _LOWER[data]
        inside = np.zeros(len(data) + 1, dtype=bool)
        np.logical_not(_SPACE[data], out=inside[:-1])
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[text_start] = True
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        word_start = np.flatnonzero(inside & (~before | edge))
        word_end = np.flatnonzero(before & (~inside | edge))
        coded = strings(data[inside[:-1]], word_end - word_start).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        yield Block((i, j), data, text_start, word_start, word_end, word, coded.dictionary, np.searchsorted(word_start, text_start))
        i = j


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Of n places, which some range of the given start and length covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
