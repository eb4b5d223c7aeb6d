"""Hashes of runs of words, as columns."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_hash(*words: Column) -> Column:
    """The hash of a run of words. Words are hashed first, so that in an array each is hashed once and not in every run that it is in."""
    return F.xxhash64(words[0]) if len(words) == 1 else F.xxhash64(*map(F.xxhash64, words))


def run_hashes(words: str, n: int) -> Column:
    """The hash of each run of n words of an array column."""
    if n == 1:
        return F.transform(words, lambda w: run_hash(w))
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    codes = F.transform(words, lambda w: F.xxhash64(w))
    shifted = [F.slice(codes, k + 1, count).alias(f"w{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(n)]))


def runs(df: DataFrame, keys: list[str], words: str, n: int) -> DataFrame:
    """keys, place and run, a row for each run of n words."""
    found = df.withColumn("_runs", run_hashes(words, n)).select(*keys, F.posexplode_outer("_runs").alias("place", "run"))
    return found.where(F.col("run").isNotNull())


#: Sizes of canons that were asked for, so that each is counted once.
_SIZES: WeakKeyDictionary[DataFrame, tuple[int, int]] = WeakKeyDictionary()


def canon_side(derived: DataFrame, passages: DataFrame, words: int = 200_000) -> DataFrame:
    """derived (a row for each passage or word of passages at most), to be broadcast if the canon has at most so many passages and words."""
    if passages not in _SIZES:
        _SIZES[passages] = tuple(passages.agg(F.count("*"), F.coalesce(F.sum(F.size("t1_words")), F.lit(0))).first())
    return F.broadcast(derived) if max(_SIZES[passages]) <= words else derived


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
