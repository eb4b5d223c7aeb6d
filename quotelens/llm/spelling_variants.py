"""Spelling variants: words that differ from a far more frequent word in one code point belong to it.

Words that differ in one inserted, deleted or replaced code point agree in the first half of the shorter word, or in the
rest of it. So a word is put, by its length, with those of the same half or rest, as a member of two lengths: its own,
and that of words with one code point less. A group of words is cut into tiles of a bounded size by a hash, and each two
tiles of a group are compared densely: the words' code points are rows of a matrix, padded at the end to count how many
each two rows share from the start, and at the start for those from the end; two words are near if both numbers
together reach the longer word's length less one. Groups lie one after another in a task, and rows at one distance from
each other are compared all at once, so small groups cost no step of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.store import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")
#: Of so many occurrences one loses a code point, by a checksum.
ONE_IN = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Code points of a text that are read at once, words that a task counts before it passes them on, words of a tile, code points of a comparison, and rows that a task compares at once.
STEP, KNOWN, TILE, CELLS, ROWS = 1_000_000, 300_000, 1024, 4_000_000, 20_000
#: Rounds of doubling: a form is five times as frequent as its word, so no chain of 64-bit counts is longer than 2**5.
ROUNDS = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs_of(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters of a whole text, in A-Z lower-cased, some at a time."""
    text, at = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        stop = NO_RUN.search(text, at + STEP)
        end = stop.end() if stop else len(text)
        yield RUN.findall(text, at, end)
        at = end


def noisy(doc_id: object, run: str, one_in: int = ONE_IN) -> str:
    """The run without one of its code points where a checksum of it and its document says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the words of whole texts that occur often enough. A null text has none; a null key is written as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                name = "" if (doc_id := doc_id.as_py()) is None else doc_id
                for runs in runs_of(body.as_py() or ""):
                    for run, n in Counter(runs).items():
                        # a run that is too short stays so
                        if len(run) >= least_length and len(word := noisy(name, run)) >= least_length:
                            total[word] += n
                    if len(total) >= KNOWN:
                        yield passed()
        if total:
            yield passed()

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _members(words: DataFrame, tile: int) -> DataFrame:
    """Each word in its groups, and there once for every tile that its own is compared with.

    _key (one for each group and two tiles), _one (1 if both are one tile), _own (the word's tile), _side, _length, word and n.
    """
    member = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("_length")).where("_length > 0")
    half = F.floor(F.col("_length") / 2).cast("int")
    rest = F.col("_length") - half
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - rest + 1, rest).alias("part")))
    member = member.select("word", "n", "_length", F.explode(ends).alias("_end")).select("word", "n", "_length", "_end.*")
    group = ["_length", "side", "part"]
    groups = member.groupBy(*group).agg(F.count("*").alias("_words"), F.count_if(F.length("word") == F.col("_length")).alias("_shorter"))
    # a group matters only if it has a word of its length, and another one; longer words make smaller tiles
    tiles = F.ceil(F.col("_words") * F.greatest(F.col("_length"), F.lit(8)) / F.lit(8 * tile)).cast("int")
    member = member.join(groups.where("_words > 1 and _shorter > 0").select(*group, tiles.alias("_tiles")), group)
    member = member.withColumn("_own", F.pmod(F.xxhash64("word"), F.col("_tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda i: F.struct(F.least(i, F.col("_own")).alias("a"), F.greatest(i, F.col("_own")).alias("b")))
    member = member.select(*group, F.explode(pairs).alias("_t"), "_own", "word", "n")
    key = F.concat_ws(" ", "_length", "side", "_t.a", "_t.b", "part")
    return member.select(key.alias("_key"), F.when(F.col("_t.a") == F.col("_t.b"), 1).otherwise(0).alias("_one"), "_own", F.col("side").alias("_side"), "_length", "word", "n")


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows as _members gives them, those of one key after one another."""
    held: list[pa.RecordBatch] = []

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if found := list(_near(table)):
            a, b = np.concatenate([np.concatenate([f, f[:, ::-1]]) for f in found]).T
            words, n = table.column(5).combine_chunks(), table.column(6).combine_chunks()
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), n.take(pa.array(b))], names=["word", "near", "near_n"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).combine_chunks()
        # the last key may go on
        done = len(keys) - int(pa.compute.sum(pa.compute.equal(keys, keys[-1])).as_py())
        if done:
            yield from compared(table.slice(0, done))
        held = table.slice(done).to_batches()
    if held:
        yield from compared(pa.Table.from_batches(held))


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' code points as rows, padded with 0 at the end, and at the start; and their numbers."""
    text = words.to_pylist()
    lengths = np.array([len(w) for w in text], dtype=np.int64)
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row, at = np.repeat(np.arange(len(text)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    shape = (len(text), int(lengths.max()))
    left, right = np.zeros(shape, dtype=np.uint32), np.zeros(shape, dtype=np.uint32)
    left[row, at] = flat
    right[row, at + shape[1] - lengths[row]] = flat
    return left, right, lengths


def _near(table: pa.Table) -> Iterator[np.ndarray]:
    """Pairs of rows of one key whose words are near; a pair is found on one side only."""
    key = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
    bounds = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
    widths = np.maximum.reduceat(np.asarray(pa.compute.utf8_length(table.column(5).combine_chunks())), bounds[:-1])
    k = 0
    while k < len(widths):
        # whole groups, as many as make matrices of a bounded size
        end, width = k + 1, int(widths[k])
        while end < len(widths) and (bounds[end + 1] - bounds[k]) * (wider := max(width, int(widths[end]))) <= CELLS:
            end, width = end + 1, wider
        for pairs in _near_rows(table.slice(bounds[k], bounds[end] - bounds[k]), key[bounds[k] : bounds[end]]):
            yield pairs + bounds[k]
        k = end


def _near_rows(table: pa.Table, key: np.ndarray) -> Iterator[np.ndarray]:
    one, own, side, length = (np.asarray(table.column(c).combine_chunks()) for c in (1, 2, 3, 4))
    left, right, lengths = code_points(table.column(5).combine_chunks())
    step = max(1, CELLS // left.shape[1])
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
    after = np.concatenate([np.arange(s)[::-1] for s in sizes])
    rows = np.arange(len(key))
    for apart in range(1, int(sizes.max())):
        rows = rows[after[rows] >= apart]
        # words of one tile meet where it is compared with itself; one of two words at least has the length of the group
        other = rows + apart
        meets = ((one[rows] == 1) | (own[rows] != own[other])) & ((lengths[rows] == length[rows]) | (lengths[other] == length[rows]))
        a, b = rows[meets], other[meets]
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            shorter, longer = np.minimum(lengths[i], lengths[j]), np.maximum(lengths[i], lengths[j])
            prefix = np.minimum(_agreed(left[i] == left[j]), shorter)
            suffix = np.minimum(_agreed((right[i] == right[j])[:, ::-1]), shorter)
            # words that agree in the first half are found by it
            near = (prefix + suffix >= longer - 1) & ((side[i] == 0) | (prefix < shorter // 2))
            if near.any():
                yield np.stack([i[near], j[near]], axis=1)


def _agreed(same: np.ndarray) -> np.ndarray:
    """How many columns from the first on are true."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, near and near_n: every two words (word, n; each once) that differ in exactly one code point, both ways."""
    rows = _members(words, tile).repartition("_key").sortWithinPartitions("_key", "word")
    return rows.mapInArrow(_near_in_groups, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n; each once).

    form: the near word of largest n, of equal ones the first by code point, if its n is times the word's or more, else null;
    form_n is its n. root: the last word that forms lead to, the word itself where it has none. n_near counts near words.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    found = near_words(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    whole = words.join(found, "word", "left").withColumn("_has", F.coalesce(-F.col("b.minus") >= F.lit(times) * F.col("n"), F.lit(False)))
    whole = whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), F.col("b.form")).alias("form"), F.when(F.col("_has"), -F.col("b.minus")).alias("form_n"))
    whole = materialize(whole, "forms")
    to = whole.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        to = materialize(to.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return whole.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
