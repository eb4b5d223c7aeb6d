"""Removal of long word sequences that an earlier document holds, by suffix automata of reference shards.

Streaming every document against the automaton of every reference shard is quadratic in the corpus, so documents only
meet the shards that can match them:

1. Documents with equal words (by 128 bits of SHA-256) are one class; all but its smallest doc_id lose all their windows at once.
2. Of each window of ``length`` words the ``gram``-word sequence with the smallest hash is its anchor. Equal windows have
   equal anchors, so only windows whose anchor two classes share can repeat.
3. Hashes of those windows are aggregated to the smallest doc_id that has each: its holder, and where it has it. Runs of
   windows that a document holds for others are the reference; it has every repeated window once. Documents are cut into
   pieces of ``reference`` windows, and pieces are dealt to shards, so a long document is in many of them.
4. In each shard a suffix automaton is built over the reference's words, each state marked with the smallest doc_id that
   ends there. It is sent to as many groups as the shard's probes need, and the other documents' runs stream through it:
   wherever the longest match reaches ``length`` words of a smaller doc_id, the window is removed. Matches are on the words
   themselves, so a hash that collides removes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.skew import join_counted
from quotelens.llm.store import materialize, release
from quotelens.llm.words import Block, blocks, covered, hashes_of_runs

#: An owner after all documents.
NOBODY = 1 << 62


@dataclass(frozen=True)
class Limits:
    """length: words of a window; gram: of an anchor; reference and probe: words of a shard's automaton, and that stream through one copy of it."""

    length: int = 50
    gram: int = 10
    reference: int = 40_000
    probe: int = 200_000


class SuffixAutomaton:
    """Of several sequences of integers, each with an owner; a state's owner is the smallest of those that end there."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [NOBODY]
        self._breaks = 0

    def _extend(self, last: int, symbol: int, owner: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.owner.append(owner)
        p = last
        while p != -1 and symbol not in nexts[p]:
            nexts[p][symbol] = state
            p = link[p]
        if p != -1:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.owner.append(NOBODY)
                while p != -1 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        return state

    def add(self, symbols: list[int], owner: int, last: int = 0) -> int:
        """Append a sequence (symbols from 0 on) and a break that matches nothing; returns where the next one goes on."""
        for symbol in symbols:
            last = self._extend(last, symbol, owner)
        self._breaks -= 1
        return self._extend(last, self._breaks - 1, NOBODY)

    def finish(self) -> None:
        """Hand each state's owner down to the suffixes it ends with."""
        owner, link = self.owner, self.link
        for state in np.argsort(-np.asarray(self.length), kind="stable").tolist():
            if state and owner[state] < owner[link[state]]:
                owner[link[state]] = owner[state]

    def held(self, symbols: list[int], length: int, before: int) -> list[int]:
        """Where a window of that length begins that an owner below before has; -1 is a symbol no sequence has."""
        nexts, link, lengths, owner = self.next, self.link, self.length, self.owner
        state = matched = 0
        found = []
        for i, symbol in enumerate(symbols):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = lengths[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            if matched >= length:
                while lengths[link[state]] >= length:
                    state = link[state]
                matched = min(matched, lengths[state])
                if owner[state] < before:
                    found.append(i - length + 1)
        return found


def anchors_of(block: Block, i: int, limits: Limits) -> np.ndarray:
    """The anchor of each window of text i."""
    first, end = block.first[i], block.first[i + 1]
    if end - first < limits.length:
        return np.zeros(0, dtype=np.uint64)
    best = hashes_of_runs(block.word_hash[first:end, 0], limits.gram)
    # minima over windows of any width by doubling
    width, want = 1, limits.length - limits.gram + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[: len(best) - (want - width)], best[want - width :]) if want > width else best


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _scan(limits: Limits):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                i, j = block.rows
                anchors = [np.unique(anchors_of(block, k, limits)).view(np.int64) for k in range(j - i)]
                shas = [_sha(block.words_of(k)) for k in range(j - i)]
                columns = [pa.array(np.diff(block.first).astype(np.int64)), pa.array(shas, pa.binary()), pa.array([x[:16] for x in shas], pa.binary()), _lists(anchors, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *columns], names=["doc", "mark", "n_words", "sha", "class", "anchors"])

    return scan


def _windows(limits: Limits):
    """Of documents with the anchors they share: the windows that can repeat, each once with its places."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                hashes, places, row = [], [], []
                for k in range(*block.rows):
                    i = k - block.rows[0]
                    shared = np.asarray(batch.column(3)[k].values, dtype=np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(anchors_of(block, i, limits), shared))
                    found = hashes_of_runs(block.word_hash[block.first[i] : block.first[i + 1], 0], limits.length)[at]
                    order = np.lexsort((at, found))
                    kinds, starts = np.unique(found[order], return_index=True)
                    hashes.append(kinds.view(np.int64))
                    places += np.split(at[order].astype(np.int32), starts[1:]) if len(kinds) else []
                    row.append(np.full(len(kinds), k))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column(0).take(take), batch.column(1).take(take), _lists(places, pa.int32())], names=["window", "doc", "class", "places"])

    return windows


def _cut(limits: Limits):
    """Of documents with their runs of windows: the words of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words = (batch.column(2)[k].as_py() or "").encode().split()
                runs = batch.column(3)[k].as_py()
                of = pa.array([k] * len(runs))
                texts = [b" ".join(words[r["start"] : r["start"] + r["windows"] + limits.length - 1]) for r in runs]
                columns = [pa.array([r[c] for r in runs], kind) for c, kind in (("holder", batch.schema.field(0).type), ("piece", pa.int64()), ("is_reference", pa.bool_()), ("start", pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns, pa.array(texts, pa.binary())], names=["doc", "class", "holder", "piece", "is_reference", "start", "words"])

    return cut


def _match(limits: Limits):
    """The windows of a group's probes that its reference holds under a smaller key."""

    def match(group: pa.Table) -> pa.Table:
        vocabulary: dict[bytes, int] = {}
        automaton, last = SuffixAutomaton(), 0
        rank = {d: i for i, d in enumerate(sorted(set(group["doc"].to_pylist()) - {None}))}
        rank[None] = NOBODY - 1
        reference = group.filter(group["is_reference"]).sort_by([("doc", "ascending"), ("class", "ascending"), ("start", "ascending")])
        for doc, words in zip(reference["doc"].to_pylist(), reference["words"].to_pylist(), strict=True):
            last = automaton.add([vocabulary.setdefault(w, len(vocabulary)) for w in words.split()], rank[doc], last)
        automaton.finish()
        probes = group.filter(pa.compute.invert(group["is_reference"]))
        row, starts, lengths = [], [], []
        for k, (doc, start, words) in enumerate(zip(*(probes[c].to_pylist() for c in ("doc", "start", "words")), strict=True)):
            # windows in a row become one span
            found = np.array(automaton.held([vocabulary.get(w, -1) for w in words.split()], limits.length, rank[doc]), dtype=np.int64)
            new = np.flatnonzero(np.append(True, found[1:] > found[:-1] + 1)) if len(found) else found
            ends = np.append(new[1:], len(found)) - 1 if len(found) else found
            row += [k] * len(new)
            starts += (start + found[new]).tolist()
            lengths += (found[ends] - found[new] + limits.length).tolist()
        of = pa.array(row, pa.int64())
        return pa.table({"doc": probes["doc"].take(of), "class": probes["class"].take(of), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})

    return match


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = covered(np.array([s["start"] for s in spans]), np.array([s["length"] for s in spans]), len(words))
            removed.append(int(gone.sum()))
            shas.append(_sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.binary())], names=["doc", "class", "n_removed", "rest"])


_OF = ["doc", "class"]


def _of_one(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b by document and class; a null key is a key."""
    other = b.withColumnsRenamed({"doc": "_d", "class": "_c"})
    return a.join(other, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("class") == F.col("_c")), how).drop("_d", "_c")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row of docs; other columns of docs are not read.

    A word goes if a window of limits.length words around it also starts in a document with a smaller key. Null and empty
    texts have no words; texts under limits.length words lose none. Rows with equal keys don't remove from each other. A
    null key counts as larger than all others. Keys are numbers or strings. Words of the result are those of the input,
    unchanged and in order.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    marked = rows.withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    scanned = materialize(marked.mapInArrow(_scan(limits), f"doc {kind}, mark string, n_words long, sha binary, class binary, anchors array<long>"), "scan")
    copies = materialize(scanned.groupBy("class").agg(F.min("doc").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("class", "keeper"), "copies")
    judged = scanned.join(copies, "class", "left").withColumn("later", F.col("keeper").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("keeper"))))
    # a class whose keeper comes in several rows is one document
    keepers = materialize(judged.where(~F.col("later") & (F.size("anchors") > 0)).select(*_OF, "mark", "anchors").dropDuplicates(_OF), "keepers")
    anchors = keepers.select(*_OF, "mark", F.explode("anchors").alias("anchor"))
    shared = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    partners = join_counted(anchors, shared, "anchor").groupBy(*_OF, "mark").agg(F.collect_set("anchor").alias("anchors"))
    # rows of equal key and text are one document again
    wanted = partners.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), "class", "anchors")
    candidates = marked.join(wanted, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))).select(*_OF, "text", "anchors").dropDuplicates(_OF)
    candidates = materialize(candidates, "candidates")
    windows = materialize(candidates.mapInArrow(_windows(limits), f"window long, doc {kind}, class binary, places array<int>"), "windows")
    first = F.col("places")[0]
    holders = windows.groupBy("window").agg(F.min("doc").alias("holder"), F.max("doc").alias("other"), F.count_if(F.col("doc").isNull()).alias("unnamed"), F.min_by(first, "doc").alias("held_at"), F.count("*").alias("n"))
    holders = materialize(holders.where("holder < other or (holder is not null and unnamed > 0)").select("window", "holder", "held_at", "n"), "holders")
    met = join_counted(windows, holders, "window").withColumn("is_reference", F.col("doc").eqNullSafe(F.col("holder")))
    met = met.where(~F.col("is_reference") | (first == F.col("held_at"))).withColumn("piece", F.floor(F.col("held_at") / limits.reference))
    met = met.select(*_OF, "holder", "piece", "is_reference", F.explode(F.when(F.col("is_reference"), F.slice("places", 1, 1)).otherwise(F.col("places"))).alias("place"))
    # places in a row are one run
    group = [*_OF, "holder", "piece", "is_reference"]
    in_order = Window.partitionBy(*_OF).orderBy("holder", "piece", "is_reference", "place")
    runs = met.withColumn("run", F.col("place") - F.row_number().over(in_order)).groupBy(*group, "run").agg(F.min("place").cast("long").alias("start"), F.count("*").alias("windows"))
    runs = materialize(runs.groupBy(*_OF).agg(F.collect_list(F.struct("holder", "piece", "is_reference", "start", "windows")).alias("runs")), "runs")
    schema = f"doc {kind}, class binary, holder {kind}, piece long, is_reference boolean, start long, words binary"
    pieces = materialize(_of_one(candidates.select(*_OF, "text"), runs).mapInArrow(_cut(limits), schema), "pieces")
    sized = pieces.withColumn("n", F.length("words"))
    # bytes stand for words here: seven to a word
    total = sized.where("is_reference").agg(F.sum("n")).first()[0] or 0
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("holder", "piece"), F.lit(1 + total // (7 * limits.reference)))).drop("holder", "piece")
    times = sized.where("not is_reference").groupBy("shard").agg((1 + F.sum("n") / F.lit(7 * limits.probe)).cast("int").alias("copies"))
    one_copy = F.array(F.pmod(F.xxhash64("doc", "class", "start"), F.col("copies")).cast("int"))
    salted = sized.join(times, "shard").withColumn("salt", F.explode(F.when(F.col("is_reference"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(one_copy)))
    # dealt out by both, since Spark would be content with the shard
    spans = salted.drop("n", "copies").repartition("shard", "salt").groupBy("shard", "salt").applyInArrow(_match(limits), f"doc {kind}, class binary, start long, length long")
    spans = spans.groupBy(*_OF).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    cleaned = _of_one(candidates.select(*_OF, "text"), spans).mapInArrow(_keep, f"doc {kind}, class binary, n_removed long, rest binary")
    cleaned = materialize(cleaned, "cleaned")
    release(keepers, shared, candidates, windows, holders, runs, pieces)
    whole = F.col("later") & (F.col("n_words") >= limits.length)
    return _of_one(judged.drop("anchors"), cleaned, "left").select(
        F.col("doc").alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(whole, F.lit(_sha([]))).otherwise(F.coalesce("rest", "sha")))).alias("kept_sha256"),
    )
