"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``chunks * per_chunk`` symbols; each is the lowest 16 bits of the smallest value that one hash function
takes over a text's distinct word shingles, so two texts differ in a symbol with probability 1 - Jaccard. Signatures that
differ in at most ``2 * chunks - 1`` symbols have, by pigeonhole, a chunk with at most one error. Every way to have one
error in a chunk is enumerated as the chunk with one symbol masked, so an equi-join on (chunk, mask, other symbols) finds
all such pairs. At 13 chunks of 5 symbols that is a distance of up to 25 of 65; two texts at a similarity of 0.85 differ
in 9.75 symbols on average, and exceed 25 about once in a million.

No bucket of the join is expanded into all of its pairs. Texts with equal shingle sets are one class from the start. Each
bucket has a hub, the class that shares most over all its buckets (of a text and its edited copies, the text), and the
others of the bucket are compared with it. The links confirmed on full sets give components. What is left are buckets whose
classes, but for the hub, are in several components: the pairs across those that can still be similar enough are found by
a prefix join over the full sets of just these classes. Shingles are ordered from the rarest on; two similar sets share one
of the first ``n - ceil(0.85 n) + 1``, and the places of the first that they share bound their intersection, so that copies
with too many edits of their own never become pairs. Within a component more links change nothing.

Hashes only find candidates and equal sets (128 bits, of real hashes of the words' bytes); links compare the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.store import materialize, release
from quotelens.llm.words import Block, blocks, hashes_of_runs, mix64, number, numbers_of_runs

_U = np.uint64
#: Bytes of texts that are compared at once.
PAIRS = 1_000_000


@dataclass(frozen=True)
class Near:
    """percent: 100 * intersection >= percent * union links two texts; shingle: words of a shingle."""

    percent: int = 85
    shingle: int = 5
    chunks: int = 13
    per_chunk: int = 5

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


def _runs(block: Block, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Text and first word of the shingles of a block, and their words: n, or all words of a text that has fewer."""
    text, counts = block.doc_of_word(), np.diff(block.first)
    at = block.places(n)
    yield text[at], at, n
    for few in range(1, n):
        short = np.flatnonzero(counts == few)
        if len(short):
            yield short, block.first[short], few


def shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and two hashes of each distinct shingle, sorted; a text of fewer than n words is one shingle, an empty one none."""
    found = []
    for text, at, size in _runs(block, n):
        found.append((text, *(hashes_of_runs(block.word_hash[:, k] ^ _U(size), size)[at] for k in (0, 1))))
    text, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((one, text))
    text, hashes = text[order], np.stack([one[order], two[order]], axis=1)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
    return text[new], hashes[new]


def signatures(text: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text with shingles: its number, a 128-bit hash of the set (from two hashes of each shingle), and k symbols."""
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return starts, np.zeros((0, 2), dtype=_U), np.zeros((0, k), dtype=np.uint16)
    sets = np.add.reduceat(mix64(hashes ^ np.array([0x51ED270B7F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=_U)), starts, axis=0)
    one = np.ascontiguousarray(hashes[:, 0])
    seeds = mix64(np.arange(1, 2 * k + 1, dtype=_U))
    symbols = np.empty((len(starts), k), dtype=np.uint16)
    for i in range(k):
        least = np.minimum.reduceat((one ^ seeds[2 * i]) * (seeds[2 * i + 1] | _U(1)), starts)
        symbols[:, i] = (mix64(least) & _U(0xFFFF)).astype(np.uint16)
    return text[starts], sets, symbols


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as bytes."""
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of _fixed."""
    column = column.cast(pa.binary())
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _sign(near: Near):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                i, j = block.rows
                text, hashes = shingles(block, near.shingle)
                has, sets, symbols = signatures(text, hashes, near.chunks * near.per_chunk)
                at = np.full(j - i, -1, dtype=np.int64)
                at[has] = np.arange(len(has))
                take = pa.array(at, mask=at < 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.bincount(text, minlength=j - i).astype(np.int64)), _fixed(sets).take(take), _fixed(symbols).take(take)],
                    names=["doc", "n_shingles", "node", "signature"],
                )

    return sign


def _buckets(near: Near):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, p = near.chunks, near.per_chunk
        place = mix64(np.arange(1, c * p + 1, dtype=_U)).reshape(c, p)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                symbols = _rows(part.column(1), np.uint16, c * p).reshape(-1, c, p).astype(_U)
                each = mix64(symbols + place)  # a sum over all but one symbol is the bucket with that one masked
                keys = mix64(each.sum(axis=2, keepdims=True) - each + place)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), c * p))], names=["bucket", "id"])

    return buckets


def _distances(near: Near):
    """Pairs with both signatures: only those within the distance."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = near.chunks * near.per_chunk
        for batch in batches:
            away = (_rows(batch.column(2), np.uint16, width) != _rows(batch.column(3), np.uint16, width)).sum(axis=1) if len(batch) else np.zeros(0)
            ok = pa.array(away <= near.distance)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away.astype(np.int32))], names=["a", "b", "away"]).filter(ok)

    return distances


def _tokens(near: Near):
    """The shingles of each text."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                text, hashes = shingles(block, near.shingle)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[block.rows[0] : block.rows[1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(np.ascontiguousarray(hashes[:, 0]).view(np.int64))], names=["id", "token"])

    return tokens


def similar(texts: pa.Array, near: Near) -> np.ndarray:
    """Whether the first text of the first half is similar enough to the first one of the second half, and so on. Words are compared, not hashes."""
    n = len(texts) // 2
    (block,) = blocks(texts, lower=True, size=1 << 62)
    found = [(text, numbers_of_runs(block.word, size)[at] * near.shingle + size - 1) for text, at, size in _runs(block, near.shingle)]
    text, shingle = (np.concatenate(x) for x in zip(*found, strict=True))
    shingle = number(shingle)
    many = shingle.max(initial=0) + 1
    kinds = np.unique((text % n) * many + shingle + (text >= n) * (n * many)) % (n * many)  # distinct shingles of each text, by pair
    kinds.sort()
    both = np.bincount(kinds[1:][kinds[1:] == kinds[:-1]] // many, minlength=n)
    union = np.bincount(kinds // many, minlength=n) - both
    return (100 * both >= near.percent * union) & (union > 0)


def _confirm(near: Near):
    """Pairs with both texts: those whose full shingle sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).cast(pa.large_string()) for k in (2, 3))
            ends = np.cumsum(pc.binary_length(one).to_numpy().astype(np.int64) + pc.binary_length(two).to_numpy())
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS)))
                yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(similar(pa.concat_arrays([one.slice(i, j - i), two.slice(i, j - i)]), near)))
                i = j

    return confirm


def _pick(near: Near):
    """The node of each text."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                i, j = block.rows
                has, sets, _ = signatures(*shingles(block, near.shingle), 0)
                yield pa.RecordBatch.from_arrays([_fixed(sets), batch.column(0).slice(i, j - i).take(pa.array(has))], names=["node", "text"])

    return pick


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node and root, the smallest node that it reaches, for all nodes of links but the roots.

    Alternating large and small stars: every node hands its neighbours on to its smallest neighbour until each is linked to
    its root alone. Rows stay in proportion to the links, and no node's neighbours meet in one task.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, done = materialize(small.distinct(), "links"), edges
        release(done)


def _alike(classes: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """classes: id, n (shingles), root. Pairs of ids of different roots that can reach the similarity: a prefix join over full sets.

    What shares a shingle is not expanded into pairs as it is. Lengths that can't be similar don't meet: a class of lengths is as
    wide as the similarity, so a pair is in one class or two neighbouring ones. Of a pair one has the shared shingle
    among the first (1 - t) / (1 + t) of its own (t: the similarity), since the places of both bound what they share. And of the root that
    has most rows of a shingle the rows meet only those of other roots. What is joined are written tables, so that Spark can split large keys.
    """
    tokens = materialize(texts.join(classes, "id").select("id", "text").mapInArrow(_tokens(near), "id long, token long"), "tokens")
    several = materialize(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "several")
    # shingles that no other class has come first in its order; they only shift the places of the rest
    own = Window.partitionBy("id")
    placed = tokens.join(several, "token").withColumn("rank", F.row_number().over(own.orderBy("often", "token"))).withColumn("kept", F.count("*").over(own))
    placed = placed.join(classes, "id").withColumn("place", F.col("n") - F.col("kept") + F.col("rank") - 1)
    share = near.percent / 100
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(share))).cast("int")
    early = F.col("place") <= F.ceil(F.col("n") * F.lit((1 - share) / (1 + share)))
    prefix = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * near.percent / 100)).select("token", "id", "n", "root", "place", length.alias("length"), early.alias("early"))
    prefix = materialize(prefix, "prefixes")
    by_root = prefix.groupBy("token", "root").agg(F.count("*").alias("rows"))
    crowd = by_root.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("rows", "root"))["root"].alias("crowd")).where("low < high").select("token", "crowd")
    crowd = materialize(crowd, "crowds")
    prefix = materialize(prefix.join(crowd, "token"), "open-prefixes")
    a, b = (prefix.select("token", *(F.col(c).alias(c[0] + i) for c in ("id", "n", "root", "place")), F.col("length").alias(f"l{i}"), F.col("early").alias(f"e{i}"), (F.col("root") == F.col("crowd")).alias(f"c{i}")) for i in "ab")
    a = a.where("not ca").withColumn("lb", F.explode(F.array(F.col("la") - 1, "la", F.col("la") + 1))).drop("la")
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    able = (100 * most >= near.percent * (F.col("na") + F.col("nb") - most)) & (F.col("ra") != F.col("rb")) & (F.col("cb") | (F.col("ia") < F.col("ib")))
    found = a.where("ea").join(b, ["token", "lb"]).where(able).select("ia", "ib").unionByName(a.where("not ea").join(b.where("eb"), ["token", "lb"]).where(able).select("ia", "ib"))
    found = materialize(found.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct(), "crossing")
    release(tokens, several, crowd, prefix)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """key, n_shingles, component_id and kept of every row of docs; other columns of docs are not read.

    Texts are lower-cased in A-Z. A text without words has no shingles and is linked with nothing. component_id is the
    smallest key of the texts that links reach; kept holds for the row of that key (for all rows of equal keys with texts
    of one component). A row without a key is in its texts' component and is kept only if no row of it has a key.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign(near), f"doc {kind}, n_shingles long, node binary, signature binary"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("id", F.xxhash64("node")), "classes")  # ids only find candidates
    buckets = classes.select("id", "signature").mapInArrow(_buckets(near), "bucket long, id long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.join(shared, "bucket"), "members")
    central = members.groupBy("id").agg(F.sum("size").alias("shares"))
    wanted = materialize(classes.join(central, "id"), "wanted")
    hubs = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("shares", "id"))["id"].alias("hub"))
    others = materialize(members.select("bucket", "id").join(hubs, "bucket").where("id != hub"), "others")
    # a merge join at every size, since the keys of a large corpus are not to be broadcast
    texts = rows.join(wanted.select(F.col("doc").alias("_d")).distinct().hint("merge"), F.col("doc").eqNullSafe(F.col("_d"))).select("text")
    texts = texts.mapInArrow(_pick(near), "node binary, text string").join(wanted.select("node", "id"), "node")
    texts = materialize(texts.dropDuplicates(["node"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs: ids a, b. The nodes of those that are linked."""
        of = lambda c: texts.select(F.col("id").alias(f"i{c}"), F.col("node").alias(f"n{c}"), F.col("text").alias(f"t{c}"))
        both = pairs.join(of("a"), F.col("a") == F.col("ia")).join(of("b"), F.col("b") == F.col("ib")).select("na", "nb", "ta", "tb")
        return both.toDF("a", "b", "ta", "tb").mapInArrow(_confirm(near), "a binary, b binary")

    met = others.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    of = lambda c: wanted.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}"))
    close = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_distances(near), "a long, b long, away int")
    links = materialize(confirmed(close.select("a", "b")), "confirmed")
    roots = materialize(components(links), "roots")
    # what the hubs left
    named = wanted.select("id", "node", "n").join(roots, "node", "left").select("id", "n", F.coalesce("root", "node").alias("root"))
    placed = others.select("bucket", "id").join(named, "id")
    apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    open_ = materialize(placed.join(apart, "bucket").select("id", "n", "root").distinct(), "open")
    crossing = _alike(open_, texts, near)
    every = components(links.union(confirmed(crossing)))
    release(members, wanted, others, texts, links, roots, open_, crossing)
    roots = every
    named = classes.select("node", "doc").join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    found = named.join(smallest, "root").select("node", "component_id")
    out = signed.drop("signature").join(found, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
