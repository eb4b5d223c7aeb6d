"""Hard negatives of anchors: rows of other labels that score nearly as high as an anchor's best rows of its own label.

Vectors are whole numbers and a score is an inner product, so scores are exact. Every vector is cut into segments, at
several lengths; of each segment its mean and its deviation (the length of what is left without the mean) are stored with
the vector. The inner product of two segments is their length times both means, plus at most the product of the
deviations, or minus it: so the sums over segments bound a score from both sides. A block of rows meets a block of anchors
by the longest segments first; pairs whose bounds can't matter are dropped, the others are refined by shorter segments, and
what is left is scored exactly.

Anchors are taken in blocks of a few MB. A block is broadcast, and one pass over the written rows finds its best rows of
the same label, a second one those of other labels. A task keeps only the best rows of each anchor so far, whose scores
tighten the bounds that later rows have to reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.store import materialize

#: Lengths of the segments, from level to level.
SEGMENTS = (16, 4)
#: Rows that are compared at once, numbers in a block of anchors, and rows in a part of the written table.
CHUNK, BLOCK_NUMBERS, PART = 4096, 2_000_000, 200_000
#: The longest whole number whose products and sums are exact in double precision; beyond it they are made in Python's own.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


@dataclass
class Vectors:
    """A block of vectors: numbers, and at each level the segments' means and deviations."""

    code: np.ndarray
    mean: list[np.ndarray]
    dev: list[np.ndarray]

    @classmethod
    def of(cls, column: pa.Array, means: pa.Array, devs: pa.Array, width: int) -> Vectors:
        """From lists of numbers, and lists of all levels' means and deviations."""
        counts = [-(-width // s) for s in SEGMENTS]
        ends = np.cumsum([0, *counts])
        levels = lambda a: [(m := np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1))[:, i:j] for i, j in zip(ends, ends[1:])]
        return cls(padded(column, width), levels(means), levels(devs))

    def norm(self) -> np.ndarray:
        return np.sqrt((self.code * self.code).sum(axis=1))

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.code[rows], [m[rows] for m in self.mean], [d[rows] for d in self.dev])


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; what a shorter one lacks is 0."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def summaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of every level, one level after another."""
    means, devs = [], []
    for length in SEGMENTS:
        cut = np.pad(code, ((0, 0), (0, -code.shape[1] % length))).reshape(len(code), -1, length)
        means.append(cut.mean(axis=2))
        devs.append(np.sqrt(((cut - means[-1][:, :, None]) ** 2).sum(axis=2)))
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, as whole numbers; those beyond 64 bits are held at the limit."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LARGEST, LARGEST).astype(np.int64)


def candidates(anchors: Vectors, rows: Vectors, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor the wanted rows whose score may be from low to high, with their exact scores: anchor, rows, scores.

    wanted: for each anchor and row whether it counts at all. A pair is dropped at the first level whose bounds lie outside.
    most: only so many of an anchor's best rows are asked for, so low rises to what so many rows score at least.
    """
    a, r, keep, low = np.arange(len(low)), np.arange(rows.code.shape[0]), wanted, low.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-9 * anchors.norm()[:, None] * rows.norm()[None, :] + 1e-3
        for level, length in enumerate(SEGMENTS):
            a, r, keep = _left(a, r, keep)
            if not len(a):
                return
            middle = anchors.mean[level][a] @ rows.mean[level][r].T * length
            off = anchors.dev[level][a] @ rows.dev[level][r].T + slack[np.ix_(a, r)]
            if most is not None and len(r) >= most:
                least = np.where(keep & ~np.isnan(middle - off), middle - off, -np.inf)
                low[a] = np.maximum(low[a], np.partition(least, len(r) - most, axis=1)[:, len(r) - most])
            # a bound that isn't a number says nothing
            keep = keep & ~((middle + off < low[a, None]) | (middle - off > high[a, None]))
    a, r, keep = _left(a, r, keep)
    if not len(a):
        return
    scores = exact_scores(anchors.code[a], rows.code[r])
    for i, anchor in enumerate(a):
        chosen = np.flatnonzero(keep[i])
        yield int(anchor), r[chosen], scores[i, chosen]


def _left(a: np.ndarray, r: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some_a, some_r = keep.any(axis=1), keep.any(axis=0)
    return a[some_a], r[some_r], keep[np.ix_(some_a, some_r)]


def _best(held: list[tuple], scores: np.ndarray, ids: np.ndarray, none: np.ndarray, most: int) -> list[tuple]:
    """The best of what is held and new rows: (-score, whether the id is null, id), smallest first."""
    if len(scores) > 4 * most:
        # of equal scores any number may be at the edge, so all of them stay for the sort
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        fits = scores >= edge
        scores, ids, none = scores[fits], ids[fits], none[fits]
    order = np.lexsort((ids, none, -scores))[:most]
    return sorted([*held, *((-int(scores[i]), bool(none[i]), int(ids[i])) for i in order)])[:most]


def prepared(vectors: DataFrame, key: str, vector: str, label: str, anchor: Column, width: int) -> DataFrame:
    """Rows that take part, written with a number of their own and their summaries: _row, _id, _label, _anchor, _code, _mean, _dev."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{label}`").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.col(f"`{vector}`").alias("_code"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                means, devs = summaries(padded(part.column(3), width))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.nan_to_num(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in (means, devs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "_mean", "_dev"])

    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART))
    out = rows.repartition(parts).mapInArrow(summed, f"_id long, _label {dict(rows.dtypes)['_label']}, _anchor boolean, _code array<double>, _mean array<double>, _dev array<double>")
    return materialize(out.withColumn("_row", F.monotonically_increasing_id()), "vectors")


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, least: float = 0.8, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """For every anchor and each of its best rows of the same label: the best rows of other labels that score from least times as high to as high.

    vectors: key (a whole number), vector (whole numbers, as any numeric type) and label; other columns are not read.
    anchor says which rows are anchors. Rows with a null label, a null vector, or a component that is null or not finite take
    no part. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Higher scores come first, ties by the smaller key, a null key last. An anchor is not its own positive, but an equal row
    is. Rows with equal keys are rows of their own, anchors too. Of vectors of different lengths the shorter one ends with
    zeros. least is read to thousandths. Empty tables, and anchors without positives or negatives, give no rows.
    """
    finite = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    takes_part = vectors.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).where(finite)
    takes_part = takes_part.withColumn(vector, F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")))
    width = max(1, takes_part.agg(F.max(F.size(f"`{vector}`"))).first()[0] or 0)
    rows = prepared(takes_part, key, vector, label, anchor, width)
    size = max(16, block_numbers // width)
    blocks = -(-rows.where("_anchor").count() // size)
    block = F.pmod(F.xxhash64("_row"), F.lit(max(blocks, 1)))
    found = [_of_block(rows, rows.where(F.col("_anchor") & (block == b)), width, positives, negatives, round(1000 * least)) for b in range(blocks)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found)


def _of_block(rows: DataFrame, some: DataFrame, width: int, positives: int, negatives: int, least: int) -> DataFrame:
    """The result for some anchors, few enough for the driver and each task to hold."""
    spark = rows.sparkSession
    table = some.select("_row", "_id", "_label", "_code", "_mean", "_dev").toArrow().combine_chunks()
    # labels are compared by their text, which is one for one label
    names = table.column("_label").cast(pa.string()).to_numpy(zero_copy_only=False)
    number = np.asarray(table.column("_row").to_numpy())
    sent = spark.sparkContext.broadcast((number, names, Vectors.of(*(table.column(c).combine_chunks() for c in ("_code", "_mean", "_dev")), width)))
    scan = rows.select("_row", "_id", F.col("_label").cast("string").alias("_label"), "_code", "_mean", "_dev")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                yield np.asarray(part.column(0)), np.asarray(part.column(1).fill_null(0)), np.asarray(part.column(1).is_null()), part.column(2).to_numpy(zero_copy_only=False), Vectors.of(*part.columns[3:], width)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_label, vectors = sent.value
        held: list[list[tuple]] = [[] for _ in own]
        for row, ids, none, label, part in chunks(batches):
            for name in set(label) & set(own_label):
                a, r = np.flatnonzero(own_label == name), np.flatnonzero(label == name)
                low = np.array([-held[i][-1][0] if len(held[i]) == positives else -math.inf for i in a])
                wanted = own[a][:, None] != row[r][None, :]
                for i, at, scores in candidates(vectors.take(a), part.take(r), wanted, low, np.full(len(a), math.inf), positives):
                    held[a[i]] = _best(held[a[i]], scores, ids[r[at]], none[r[at]], positives)
        yield _table([(int(own[i]), None, *x) for i, best in enumerate(held) for x in best], pa.int64())

    schema = "_anchor long, _for {}, _minus long, _none boolean, _id long"
    ranked = Window.partitionBy("_anchor").orderBy("_minus", "_none", "_id")
    best = scan.mapInArrow(alike, schema.format("long")).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= positives)
    best = materialize(best.select("_anchor", "k", F.when(~F.col("_none"), F.col("_id")).alias("positive_id"), (-F.col("_minus")).alias("score")), "positives")
    # a row for each anchor of the block and positive: as bounded as the block
    bands: list[list[tuple[int, int, int]]] = [[] for _ in number]
    place = {int(x): i for i, x in enumerate(number)}
    for x in best.select("_anchor", "k", "score").collect():
        lowest = -(-least * x["score"] // 1000)
        if lowest <= x["score"]:
            bands[place[x["_anchor"]]].append((x["k"], lowest, x["score"]))
    asked = spark.sparkContext.broadcast(bands)

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_label, vectors = sent.value
        wanted_bands = asked.value
        held = {(i, k): [] for i, band in enumerate(wanted_bands) for k, _, _ in band}
        with_any = np.array([i for i, band in enumerate(wanted_bands) if band], dtype=np.int64)
        for _, ids, none, label, part in chunks(batches):
            if not len(with_any):
                break
            # a band that has all its rows is open only above the last of them
            floor = lambda i, k, lowest: max(lowest, -held[i, k][-1][0]) if len(held[i, k]) == negatives else lowest
            low = np.array([min(floor(i, k, x) for k, x, _ in wanted_bands[i]) for i in with_any], dtype=np.float64)
            high = np.array([max(x for _, _, x in wanted_bands[i]) for i in with_any], dtype=np.float64)
            wanted = own_label[with_any][:, None] != label[None, :]
            for i, at, scores in candidates(vectors.take(with_any), part, wanted, low, high):
                for k, lowest, highest in wanted_bands[with_any[i]]:
                    fits = at[(scores >= lowest) & (scores <= highest)]
                    if len(fits):
                        held[with_any[i], k] = _best(held[with_any[i], k], scores[(scores >= lowest) & (scores <= highest)], ids[fits], none[fits], negatives)
        yield _table([(int(own[i]), k, *x) for (i, k), found in held.items() for x in found], pa.int32())

    ranked = Window.partitionBy("_anchor", "_for").orderBy("_minus", "_none", "_id")
    worst = scan.mapInArrow(unlike, schema.format("int")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    worst = worst.select("_anchor", F.col("_for").alias("k"), "rank", F.when(~F.col("_none"), F.col("_id")).alias("negative_id"), (-F.col("_minus")).alias("negative_score"))
    ids = some.select(F.col("_row").alias("_anchor"), F.col("_id").alias("anchor_id"))
    out = worst.join(best, ["_anchor", "k"]).join(ids, "_anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def _table(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["_anchor", "_for", "_minus", "_none", "_id"])
