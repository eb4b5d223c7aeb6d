"""Joins by keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is large if it has more than this part of all rows; so there are at most so many of them.
PARTS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n", parts: int = PARTS) -> DataFrame:
    """rows joined with counted: a written table with one row for each key, and n, the key's number of rows.

    Rows of large keys stay where they are: those keys, at most parts of them whatever the input, are broadcast. All
    other rows are shuffled by key. counted is read several times, and n is no column of rows.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    is_large = F.col(n) * parts > total
    large = F.broadcast(counted.where(is_large))
    rest = rows.join(large.select(key), key, "left_anti").join(counted.where(~is_large), key)
    return rows.join(large, key).unionByName(rest).drop(n)
