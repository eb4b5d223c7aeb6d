"""Packing of tokenized documents into windows of one length, with as few cuts and as little padding as may be.

A document's full windows are sequences of their own; what is left of it, shorter than a window, is a rest. Rests of one
length are alike, so all that is planned is how often to use which combination of lengths: combinations that fill a window
exactly are enumerated (one or two lengths, repeated, or three different ones), non-negative least squares fits their
repeat counts to the histogram of rests, the counts are rounded down to what the histogram allows, and whatever rests
still fit a combination are put into one greedily. Rests that fit none are laid end to end and cut where a window ends; the
last window's tokens become sequences of powers of two, which need no padding. So no sequence is padded at all.

The histogram has fewer entries than a window has tokens, whatever the input, and the plan is made from it on the driver.
Tokens are written once with each rest's rank within its part of the input; a part's ranks follow those of the
parts before it, so a rest finds its place in the plan by its length and rank, and no task holds all rests of a length.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.windows import if_small
from quotelens.llm.store import materialize

WINDOW, END = 2048, 1
#: Combinations kept for each length (those that could be used most often come first), and passes over all of them.
PER_LENGTH, PASSES = 48, 12
#: Rows of the table of ranks up to which it is broadcast, and tokens that are passed on at once.
SMALL, BATCH_TOKENS = 200_000, 2_000_000


@dataclass(frozen=True)
class BytePairs:
    """A byte-pair vocabulary as a tokenizer's file, and as its ranks. Both are of a bounded size, and are broadcast."""

    file: str
    ranks: str
    pattern: str

    @classmethod
    def load(cls, file: str, ranks: str, pattern: str) -> BytePairs:
        """Read both files, by path."""
        with open(file, encoding="utf-8") as a, open(ranks, encoding="utf-8") as b:
            return cls(a.read(), b.read(), pattern)

    def encoder(self) -> Callable[[str], list[int]]:
        """text -> ids, as the file's tokenizer gives them without special tokens of its own: those that the text writes out are ids.

        Ranks are merged some five times faster; a text that this can't take goes to the file's tokenizer.
        """
        import tiktoken

        special = {t["content"]: t["id"] for t in json.loads(self.file)["added_tokens"]}
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, self.ranks.splitlines())}
        fast = tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        known = set(special)
        slow = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special=known, disallowed_special=())
            except BaseException as e:  # a panic of the library is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_str(self.file))
            return slow[0].encode(text, add_special_tokens=False).ids

        return encode


def combinations(histogram: np.ndarray, window: int = WINDOW, per_length: int = PER_LENGTH) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of lengths that fill a window: ((length, times), ...). histogram: rests of each length from 0 to window - 1.

    One or two lengths repeated, or three different ones; of each longest length the per_length that could be used most often.
    """
    present = [int(x) for x in np.flatnonzero(histogram)]
    there = np.zeros(window + 1, dtype=np.int64)
    there[: len(histogram)] = histogram
    out: list[tuple[tuple[int, int], ...]] = []
    for long in present:
        found: dict[tuple, int] = {}
        for times in range(1, min(window // long, int(there[long])) + 1):
            rest = window - times * long
            if not rest:
                found[((long, times),)] = int(there[long]) // times
                continue
            for again in range(1, rest + 1):
                short = rest // again
                if short * 4 < rest and again > 64:
                    break
                if rest % again == 0 and short < long and there[short] >= again:
                    found[((long, times), (short, again))] = int(min(there[long] // times, there[short] // again))
        middle = np.arange(max(1, (window - long) // 2), min(long, window - long))
        last = window - long - middle
        fits = (last > 0) & (last < middle) & (there[middle] > 0)
        middle, last = middle[fits], last[fits]
        counts = np.minimum(np.minimum(there[middle], there[last]), there[long])
        for i in np.argsort(-counts, kind="stable")[:per_length]:
            if counts[i] > 0:
                found[((long, 1), (int(middle[i]), 1), (int(last[i]), 1))] = int(counts[i])
        out += sorted(found, key=lambda c: (-found[c], c))[:per_length]
    return out


def repeat_counts(columns: list[tuple[tuple[int, int], ...]], histogram: np.ndarray, passes: int = PASSES, still: float = 1e-3) -> list[float]:
    """How often to use each combination: non-negative least squares against the histogram, by coordinate descent.

    It ends after so many passes, or with one that moves counts by less than still of their sum: they are rounded anyway.
    """
    left = [float(x) for x in histogram]
    norms = [sum(t * t for _, t in c) for c in columns]
    counts = [0.0] * len(columns)
    for _ in range(passes):
        moved = 0.0
        for k, column in enumerate(columns):
            step = sum(t * left[x] for x, t in column) / norms[k]
            step = max(step, -counts[k])
            if step:
                counts[k] += step
                for x, t in column:
                    left[x] -= t * step
                moved += abs(step)
        if moved < still * max(sum(counts), 1.0):
            break
    return counts


@dataclass(frozen=True)
class Plan:
    """Where rests go. slots: for a length, (first rank, end rank, first sequence, offset) of each place in a combination, by rank.

    loose: for a length the first rank that no combination takes, and where its tokens begin among all loose ones. Loose
    tokens fill windows from sequence loose_from on, the last of them the sequences that end at tail.
    """

    window: int
    slots: dict[int, list[tuple[int, int, int, int]]]
    loose: dict[int, tuple[int, int]]
    loose_from: int
    full_windows: int
    tail: tuple[int, ...]

    @classmethod
    def of(cls, histogram: np.ndarray, full: int, window: int = WINDOW) -> Plan:
        """histogram: rests of each length; full: sequences before these, a document's full windows."""
        left = np.array(histogram, dtype=np.int64)
        columns = combinations(left, window)
        wanted = repeat_counts(columns, left)
        used = [0] * len(columns)

        def use(k: int, most: int) -> None:
            n = min(most, min(int(left[x]) // t for x, t in columns[k]))
            used[k] += n
            for x, t in columns[k]:
                left[x] -= n * t

        by_count = sorted(range(len(columns)), key=lambda k: (-wanted[k], k))
        for k in by_count:
            use(k, int(wanted[k] + 1e-6))
        # what rounding left over, as long as it fills windows
        for k in by_count:
            use(k, int(left.sum()))
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        rank = [0] * window
        sequence = full
        for k, n in enumerate(used):
            if not n:
                continue
            offset = 0
            for length, times in columns[k]:
                for _ in range(times):
                    slots.setdefault(length, []).append((rank[length], rank[length] + n, sequence, offset))
                    rank[length] += n
                    offset += length
            sequence += n
        loose, begin = {}, 0
        for length in range(1, window):
            if left[length]:
                loose[length] = (rank[length], begin)
                begin += length * int(left[length])
        ends, at = [], 0
        for bit in reversed(range(window.bit_length())):
            if (begin % window) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        return cls(window, slots, loose, sequence, begin // window, tuple(ends))

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """The pieces of a rest: (length, sequence, offset) of each."""
        for first, end, sequence, offset in self.slots.get(length, ()):
            if first <= rank < end:
                return [(length, sequence + rank - first, offset)]
        first, begin = self.loose[length]
        at = begin + (rank - first) * length
        end, out = at + length, []
        while at < end:
            number, offset = divmod(at, self.window)
            if number < self.full_windows:
                stop, sequence = (number + 1) * self.window, self.loose_from + number
            else:
                before = self.full_windows * self.window
                k = next(i for i, e in enumerate(self.tail) if at - before < e)
                begins = self.tail[k - 1] if k else 0
                stop, sequence, offset = before + self.tail[k], self.loose_from + self.full_windows + k, at - before - begins
            out.append((min(stop, end) - at, sequence, offset))
            at = min(stop, end)
        return out


def tokenized(docs: DataFrame, vocabulary: BytePairs, key: str, text: str, window: int, end: int) -> DataFrame:
    """Every row's ids, written with its rank: _key, _part (its task), _ids (16 bits each, or 32), _n, _rest, _rank and _full.

    _rank: rows before it in its part with as long a rest; _full: full windows before it in its part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = sent.value.encoder(), TaskContext.get().partitionId()
        seen, full = np.zeros(window, dtype=np.int64), 0
        keys: list[pa.Array] = []
        rows: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            made = [pa.concat_arrays(keys), pa.array([part] * len(rows), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]]
            return pa.RecordBatch.from_arrays(made, names=["_key", "_part", "_ids", "_n", "_rest", "_rank", "_full"])

        for batch in batches:
            for i in range(len(batch)):
                ids = np.array([*encoder(batch.column(1)[i].as_py() or ""), end], dtype="<u4")
                n, rest = len(ids), len(ids) % window
                keys.append(batch.column(0).slice(i, 1))
                rows.append((ids.tobytes() if ids.max() > 0xFFFF else ids.astype("<u2").tobytes(), n, rest, int(seen[rest]), full))
                seen[rest] += 1
                full += n // window
                tokens += n
                if tokens >= BATCH_TOKENS:
                    yield flush()
                    keys, rows, tokens = [], [], 0
        if rows:
            yield flush()

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return materialize(rows.mapInArrow(encode, f"_key {dict(rows.dtypes)['_key']}, _part int, _ids binary, _n long, _rest int, _rank long, _full long"), "tokens")


def pack_documents(docs: DataFrame, vocabulary: BytePairs, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all rows of docs in sequences of at most window tokens: key, start, length, ids, doc_tokens, sequence_id and offset.

    A document is its text's ids and the id end; start is the number of its ids before the piece, ids are the piece's own (32
    bits each, little-endian), doc_tokens are those of the document. offset is where the piece lies in its sequence; sequences are numbered from 0
    without gaps. All of them have window tokens but those of the last window's, which have powers of two: none needs padding.

    A null or empty text is the id end alone. Rows with equal keys, or a null one, are documents of their own. Other columns of
    docs are not read. An empty table has no pieces. Which document of a length comes first depends on the order of the input.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("a window is a power of two, from 2 on")
    rows = tokenized(docs, vocabulary, key, text, window, end)
    spark = docs.sparkSession
    counted = rows.groupBy("_part", F.col("_rest").alias("_length")).agg(F.count("*").alias("n")).where("_length > 0")
    counted = counted.unionByName(rows.groupBy("_part").agg(F.sum(F.floor(F.col("_n") / window)).alias("n")).select("_part", F.lit(window).alias("_length"), "n"))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part and length: small beside the tokens
    ranks = materialize(counted.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    totals = {x["_length"]: x["n"] for x in ranks.groupBy("_length").agg(F.sum("n").alias("n")).collect()}
    histogram = np.array([totals.get(x, 0) for x in range(window)], dtype=np.int64)
    plan = spark.sparkContext.broadcast(Plan.of(histogram, int(totals.get(window) or 0), window))
    of_full = ranks.where(F.col("_length") == window).select("_part", F.col("_before").alias("_full_before"))
    of_rest = ranks.where(F.col("_length") < window).select("_part", F.col("_length").alias("_rest"), F.col("_before").alias("_rest_before"))
    placed = rows.join(if_small(of_full, SMALL), "_part").join(if_small(of_rest, SMALL), ["_part", "_rest"], "left")
    placed = placed.select("_key", "_ids", "_n", "_rest", (F.col("_full") + F.col("_full_before")).alias("_first"), (F.coalesce("_rest_before", F.lit(0)) + F.col("_rank")).alias("_rank"))
    kind = dict(docs.select(F.col(f"`{key}`").alias("_key")).dtypes)["_key"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = plan.value
        names = ["_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            owner, *columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

        for batch in batches:
            raw, n, rest, first, rank = batch.column(1), *[c.to_pylist() for c in batch.columns[2:]]
            out, tokens = [], 0
            for i in range(len(batch)):
                data = raw[i].as_py()
                ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * n[i] else "<u4").astype("<u4")
                pieces = [(window, first[i] + k, 0) for k in range(n[i] // window)]
                pieces += chosen.places(rest[i], rank[i]) if rest[i] else []
                start = 0
                for length, sequence, offset in pieces:
                    out.append((i, start, length, ids[start : start + length].tobytes(), n[i], sequence, offset))
                    start += length
                    tokens += length
                    if tokens >= BATCH_TOKENS:
                        yield made(batch, out)
                        out, tokens = [], 0
            if out:
                yield made(batch, out)

    return placed.mapInArrow(cut, f"_key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("_key", key)
