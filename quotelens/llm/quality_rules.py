"""Quality rules: base counts of a text, and a verdict on its repeated substrings from a suffix array over its words.

Suffixes are sorted by prefix doubling, for many texts at once: after the round of 2^k words each suffix has the rank of
its first 2^k words within its text, and only suffixes that still share a rank are sorted again. The longest common prefixes
of neighbours in suffix order follow from the ranks kept of each round. A maximal repeated substring is an interval of the
array whose common prefix can't be extended without losing an occurrence; the words that repeats of at least
``min_repeat`` words cover are the union of the spans of all suffixes whose larger neighbouring prefix is that long. A text
is rejected if those words are more than ``max_covered`` of it, or its longest repeat has more than ``max_longest`` words.
The base rule on repeated windows implies the first of these where its limit is as high; so repeats of at least ``min_copy``
words, twice as long, may cover half as much, ``max_copied``: such a run is no phrase but copied sentences.
Words and lines are compared by their bytes, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotelens.llm.words import Block, blocks, covered, number, per_text, strings

#: Characters that count as symbols (fixed by the contract of the base counts).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    min_repeat: int = 8
    max_covered: float = 0.2
    max_longest: int = 60
    min_copy: int = 16
    max_copied: float = 0.1


def suffix_order(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over all texts, texts apart, and the common prefix of each suffix with the one before it, in words.

    keys: a word's number, alike for equal words only; text: the text of each word, ascending.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rank = keys.copy()
    order = np.lexsort((rank, text))
    new = np.ones(n, dtype=bool)
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (text[order][1:] != text[order][:-1])
    ends = np.searchsorted(text, text, side="right")
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place where a suffix's group begins
    rounds, step = [], 1
    while not new.all():
        rounds.append(rank.copy())
        after = np.where(np.arange(n) + step < ends, 0, -1)
        after[after == 0] = rank[np.flatnonzero(after == 0) + step]
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        those = order[places]
        again = np.lexsort((after[those], rank[those]))
        those = those[again]
        order[places] = those
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (rank[those][1:] != rank[those][:-1]) | (after[those][1:] != after[those][:-1])
        new[places] |= fresh
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[those] = begin[places]
        step *= 2
    common = np.zeros(n, dtype=np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    same = text[a] == text[b]
    for k in range(len(rounds) - 1, -1, -1):
        ok = same & (a < ends[order[1:]]) & (b < ends[order[:-1]])
        ok[ok] = rounds[k][a[ok]] == rounds[k][b[ok]]
        # ranks of a round compare 2^k words only where that many are left in both
        length = 1 << k
        ok &= (a + length <= ends[order[1:]]) & (b + length <= ends[order[:-1]])
        common[1:][ok] += length
        a[ok] += length
        b[ok] += length
    return order, common


def reach(block: Block) -> np.ndarray:
    """For each word of a block the longest run of words from it on that comes again in its text."""
    order, common = suffix_order(block.word, block.doc_of_word())
    out = np.zeros(len(order), dtype=np.int64)
    if len(order):
        out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def within(block: Block, reaches: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """For each text the words in repeats of at least so many words, of which each is cut to most words."""
    long = np.flatnonzero(reaches >= least)
    return per_text(covered(long, reaches[long] if most is None else np.minimum(reaches[long], most), len(reaches)), block.first)


def repeated_lines(block: Block) -> np.ndarray:
    """For each text the lines with a word that are equal to an earlier one of it."""
    data, first, n_texts = block.data, block.first, len(block.first) - 1
    cuts = np.flatnonzero(data == 0x0A)
    # lines begin where a text does and after line feeds
    owner = np.concatenate([np.arange(n_texts), np.searchsorted(block.text_start, cuts, side="right") - 1])
    starts = np.concatenate([block.text_start[:-1], cuts + 1])
    by = np.lexsort((starts, owner))
    starts, owner = starts[by], owner[by]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = block.text_start[owner[last] + 1]
    wordy = np.searchsorted(block.word_start, ends) > np.searchsorted(block.word_start, starts)
    line = strings(data[data != 0x0A], ends - starts).dictionary_encode().indices.to_numpy().astype(np.int64)[wordy]
    owner = owner[wordy]
    distinct = np.unique(number(owner * (line.max(initial=0) + 1) + line), return_index=True)[1]
    return np.bincount(owner, minlength=n_texts) - np.bincount(owner[distinct], minlength=n_texts)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    data = block.data
    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[block.word_start] += 1
    np.subtract.at(in_word, block.word_end, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(block.first),
        "word_chars": per_text(in_word & ((data & 0xC0) != 0x80), block.text_start),
        "n_symbols": per_text(symbol[data], block.text_start),
        "n_dup_lines": repeated_lines(block),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdicts, one row for each row of docs (repeated rows too); other columns of docs are not read.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words, copied_words,
    longest_repeat and kept. A null or empty text has no words and fails the base rules. The key is passed on as it is, null too.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                counts, reaches = base_counts(block), reach(block)
                words = counts["n_words"]
                counts["n_repeat_words"] = within(block, reaches, rules.window, rules.window)
                failed = (words < rules.min_words) | (100 * counts["n_repeat_words"] > rules.max_repeat_percent * words)
                inside, copied = within(block, reaches, rules.min_repeat), within(block, reaches, rules.min_copy)
                longest = np.zeros(len(words), dtype=np.int64)
                np.maximum.at(longest, block.doc_of_word(), reaches)
                kept = ~failed & (inside <= rules.max_covered * words) & (copied <= rules.max_copied * words) & (longest <= rules.max_longest)
                columns = [counts[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                i, j = block.rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, [*columns, failed, inside, copied, longest, kept])], names=names)

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, copied_words long, longest_repeat long, kept boolean"
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "copied_words", "longest_repeat", "kept"]
    return rows.mapInArrow(judge, schema)
