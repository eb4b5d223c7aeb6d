"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Each text gives a few statistics (shares of symbols, capitals, digits, repeated words and lines, lengths). They are
standardised, and mapped to ``features`` cosines of random projections, whose inner products approximate a Gaussian
kernel. Each partition of the labelled rows sums its part of the normal equations; the sums are added in fixed point, so
that no order of adding changes them, and only their sum (a matrix of fixed size) reaches the driver, which solves for
the ridge weights. Raw scores of the training rows are counted in fixed bins, and pooling adjacent violators over the
bins gives a monotone map from raw scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.store import materialize, release
from quotelens.llm.words import Block, blocks, numbers_of_runs, per_text

#: Fixed point of sums.
SCALE = float(1 << 30)
NAMES = (
    "words", "word_length", "symbols", "capitals", "digits", "ends", "exclamations", "bars", "spaces", "lines", "line_words",
    "distinct_words", "repeat_next", "repeat_pairs", "top_word", "symbol_words", "other_bytes", "long_words", "short_words",
)


@dataclass(frozen=True)
class Kernel:
    """features: of the Fourier map; width: of the Gaussian, in standard deviations; ridge: of the normal equations; bins: of raw scores from -0.5 to 1.5."""

    features: int = 160
    width: float = 4.0
    ridge: float = 1.0
    bins: int = 2000
    seed: int = 11


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _CAPITAL, _DIGIT = _table(b"#*$%&|<>@^~{}[]\\=+_"), _table(bytes(range(65, 91))), _table(b"0123456789")
_END, _SHOUT, _BAR, _SPACE, _LINE = _table(b".,;:?"), _table(b"!"), _table(b"|"), _table(b" \t\r\n\v\f"), _table(b"\n")
_OTHER, _LETTER = _table(bytes(range(128, 256))), _table(bytes(range(97, 123)))


def statistics(block: Block) -> np.ndarray:
    """A row for each text, a column for each of NAMES."""
    n_texts = len(block.first) - 1
    text, word = block.doc_of_word(), block.word
    words, size = np.diff(block.first), np.maximum(np.diff(block.text_start), 1)
    some = np.maximum(words, 1)
    share = lambda table: per_text(table[block.data], block.text_start) / size
    lengths = block.word_end - block.word_start
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    lines = per_text(_LINE[block.data], block.text_start) + 1

    def repeated(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the count of the commonest, for each text."""
        order = np.lexsort((values, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n_texts)
        np.maximum.at(most, owner[order][at], np.diff(np.append(at, len(order))))
        return np.bincount(owner[order][at], minlength=n_texts), most

    distinct, most = repeated(word, text)
    same = text[1:] == text[:-1]
    next_one = np.bincount(text[1:][same & (word[1:] == word[:-1])], minlength=n_texts)
    pairs = np.bincount(text[1:][same], minlength=n_texts)
    at = block.places(2)
    distinct_pairs, _ = repeated(numbers_of_runs(word, 2)[at], text[at])
    columns = [
        np.log1p(words), per_text(lengths, block.first) / some, share(_SYMBOL), share(_CAPITAL), share(_DIGIT), share(_END), share(_SHOUT), share(_BAR), share(_SPACE), np.log1p(lines), np.log1p(words / lines),
        distinct / some, next_one / some, 1 - distinct_pairs / np.maximum(pairs, 1), most / some, per_text(symbols[block.word_end] > symbols[block.word_start], block.first) / some, share(_OTHER), per_text(lengths > 15, block.first) / some, per_text(lengths <= 2, block.first) / some,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            i, j = block.rows
            values = statistics(block)
            offsets = pa.array(np.arange(j - i + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))], names=["doc", "statistics"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    kernel: Kernel

    def map(self, values: np.ndarray) -> np.ndarray:
        rng = np.random.RandomState(self.kernel.seed)
        directions = rng.normal(0, 1 / self.kernel.width, (len(NAMES), self.kernel.features))
        phases = rng.uniform(0, 2 * np.pi, self.kernel.features)
        standard = np.clip((values - self.mean) / self.spread, -8, 8)
        cosines = np.sqrt(2 / self.kernel.features) * np.cos(standard @ directions + phases)
        return np.concatenate([cosines, np.ones((len(values), 1))], axis=1)

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.map(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(values), self.edges, self.levels)


def isotonic(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean centre and the level of each block, levels rising."""
    stack: list[list[float]] = []
    for centre, count, total in zip(centres, counts, sums, strict=True):
        stack.append([centre * count, count, total])
        while len(stack) > 1 and stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    return np.array([s[0] / s[1] for s in stack]), np.array([s[2] / s[1] for s in stack])


def fit(training: DataFrame, kernel: Kernel) -> Model | None:
    """training: statistics and label (0 or 1) of the rows to learn from; None if there are none."""
    zero = np.zeros(len(NAMES))
    columns = [F.col("statistics")[i] for i in range(len(NAMES))]
    fixed = lambda c: F.sum(F.round(c * SCALE).cast("decimal(38,0)"))
    n, *sums = training.agg(F.count("*"), *map(fixed, columns), *(fixed(c * c) for c in columns)).first()
    if not n:
        return None
    first, second = (np.array([float(x) for x in part]) / SCALE / n for part in (sums[: len(NAMES)], sums[len(NAMES) :]))
    spread = np.sqrt(np.maximum(second - first**2, 0))
    model = Model(first, np.where(spread > 1e-6, spread, 1.0), np.zeros(kernel.features + 1), zero[:1], zero[:1], kernel)
    width = kernel.features + 2

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                rows = np.concatenate([model.map(_matrix(batch.column(0))), np.asarray(batch.column(1), dtype=float)[:, None]], axis=1)
                total += rows.T @ rows
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.rint(total[i, j] * SCALE).astype(np.int64))], names=["i", "j", "part"])

    summed = training.select("statistics", "label").mapInArrow(equations, "i int, j int, part long").groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
    full = np.zeros((width, width))
    for i, j, value in summed.collect():  # width * (width + 1) / 2 rows, whatever the input
        full[i, j] = full[j, i] = float(value) / SCALE
    penalty = kernel.ridge * np.eye(width - 1)
    penalty[-1, -1] = 0
    model = Model(model.mean, model.spread, np.linalg.solve(full[:-1, :-1] + penalty + 1e-9 * np.eye(width - 1), full[:-1, -1]), zero[:1], zero[:1], kernel)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * kernel.bins).astype(np.int64), 0, kernel.bins - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    counted = training.select("statistics", F.col("label").cast("long").alias("label")).mapInArrow(binned, "bin long, label long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    bins = np.array(sorted(map(tuple, counted.collect())), dtype=float)  # kernel.bins rows at most
    edges, levels = isotonic((bins[:, 0] + 0.5) * 2 / kernel.bins - 0.5, bins[:, 1], bins[:, 2])
    return Model(model.mean, model.spread, model.weights, edges, levels, kernel)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, kernel: Kernel = Kernel()) -> DataFrame:
    """key, held_out, score and predicted of every row of docs; only key and text of docs are read, key and label of labels.

    Rows with crc32(key as text) mod folds = 0 are held out of training; a row without a key is held out. Labels that are
    null, or belong to no row of docs, teach nothing; a label counts for each row of docs that has its key. Without any
    label all scores are 0.5. Null and empty texts are scored like others.
    """
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))
    measured = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = dict(measured.dtypes)["doc"]
    measured = materialize(measured.mapInArrow(_measure, f"doc {kind}, statistics array<double>"), "statistics")
    known = labels.where(F.col(label).isNotNull() & ~held_out).select(F.col(key).alias("doc"), F.col(label).cast("double").alias("label"))
    training = materialize(measured.join(known, "doc").select("statistics", "label"), "training")
    model = fit(training, kernel)
    release(training)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(len(batch), 0.5) if model is None else model.score(_matrix(batch.column(1))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.clip(scores, 0, 1), 6))], names=[key, "score"])

    scored = measured.mapInArrow(score, f"`{key}` {kind}, score double")
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
