"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight``, where u is a hash of the
row's key and the child's path, and the smallest draw wins; a child's weight is the sum of its leaves. A weight that
changes moves rows only into or out of the subtrees on its path. A shard that is added by :meth:`HashTree.grow` becomes a
region of its own, so that it takes rows only into itself and none move between the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are counted in this many parts per shard; with the shards it bounds the broadcast table of counts.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class HashTree:
    """leaves: (region, rack, shard, weight); shards are unique, weights positive."""

    leaves: tuple[tuple[int, int, int, float], ...]

    def __post_init__(self):
        shards = [leaf[2] for leaf in self.leaves]
        if not shards or len(set(shards)) < len(shards) or min(leaf[3] for leaf in self.leaves) <= 0:
            raise ValueError("a tree needs leaves with different shards and positive weights")

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> HashTree:
        size = range(regions * racks * shards)
        return cls(tuple((i // (racks * shards), i // shards % racks, i, 1.0) for i in size))

    def grow(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a region of its own."""
        return HashTree((*self.leaves, (1 + max(x[0] for x in self.leaves), 0, 1 + max(x[2] for x in self.leaves), weight)))


def _draw(key: Column, path: str, weight: float) -> Column:
    hashed = F.xxhash64(F.concat_ws("|", key, F.lit(path))).bitwiseAND(F.lit((1 << 53) - 1))
    return -F.log((hashed + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def _descend(key: Column, path: str, leaves: list[tuple[tuple[int, ...], float]]) -> Column:
    """The leaf below path that the key draws; leaves: (the rest of the path, weight)."""
    children: dict[int, list] = {}
    for (head, *rest), weight in leaves:
        children.setdefault(head, []).append((tuple(rest), weight))
    below = {c: _descend(key, f"{path}/{c}", kids) if kids[0][0] else F.lit(c) for c, kids in sorted(children.items())}
    if len(below) == 1:
        return next(iter(below.values()))
    draws = [F.struct(_draw(key, f"{path}/{c}", sum(w for _, w in children[c])).alias("d"), F.lit(c).alias("c")) for c in below]
    winner = F.least(*draws)["c"]
    if all(not kids[0][0] for kids in children.values()):
        return winner
    *some, (_, last) = below.items()
    return reduce(lambda rest, item: F.when(winner == item[0], item[1]).otherwise(rest), reversed(some), last)


def shard_of(key: Column, tree: HashTree) -> Column:
    """The shard of a key (int). A null key is one more key, with a shard of its own choice."""
    return _descend(F.coalesce(key.cast("string"), F.lit("\0null")), "", [((a, b, c), w) for a, b, c, w in tree.leaves]).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], parts: int = SLOT_PARTS) -> DataFrame:
    """Number the rows of each shard from 0, without gaps.

    Each shard is cut into parts by a hash of the columns of order, so rows of one key are in many of them. The parts are counted, their first slots are
    broadcast (at most shards x parts rows), and rows are numbered within a part, so no task holds a whole shard.
    """
    part = F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(parts))
    counts = df.select(shard, part.alias("_part")).groupBy(shard, "_part").count()
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard), "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = df.withColumn("_part", part).withColumn("_row", F.row_number().over(within))
    slots = numbered.join(F.broadcast(first), [shard, "_part"])
    return slots.withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_first")


def shard_rows(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Place every row in a shard of tree by the law ``key``.

    Returns key, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, law, shard, slot and
    grown_shard (where the row would be with one more shard); and all other columns of docs before them if whole. Else
    other columns don't matter and are not read. A null text has the checksum of an empty one. Rows with equal keys share a
    shard; each has its own slot. With whole, columns of docs that have the name of a new one are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    new = {
        "size": (F.octet_length(body) + F.lit(8)).cast("long"),
        "text_crc32": F.crc32(body.cast("binary")),
        "law": F.lit("key"),
        "shard": shard_of(F.col(key), tree),
        "grown_shard": shard_of(F.col(key), tree.grow()),
    }
    # what is passed on is one column until the end, so that no name clashes
    old = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c == key or whole and c not in (*new, "slot")])
    rows = docs.select(old.alias("row"), F.col(key).alias("key"), *[column.alias(name) for name, column in new.items()])
    return with_slots(rows, "shard", ["key", "size", "text_crc32"]).select("row.*", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
