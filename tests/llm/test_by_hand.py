"""Sharding, the classifier and conversations against plain Python."""

import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quotelens.llm import chat_format, quality_classifier, sharding


def brute_shard(key, tree):
    """Descend the tree by the smallest of -ln(u) / weight, from a 64-bit hash of key and path."""
    key = "\0null" if key is None else str(key)
    leaves, path, at = tree.leaves, "", 0
    for level in range(3):
        weights = {}
        for leaf in leaves:
            weights[leaf[level]] = weights.get(leaf[level], 0) + leaf[3]
        hashed = {c: xxhash.xxh64_intdigest(f"{key}|{path}/{c}".encode(), seed=42) & ((1 << 53) - 1) for c in weights}
        at = min(weights, key=lambda c: -math.log((hashed[c] + 0.5) / (1 << 53)) / weights[c]) if len(weights) > 1 else next(iter(weights))
        leaves, path = [leaf for leaf in leaves if leaf[level] == at], f"{path}/{at}"
    return at


def test_shards_equal_brute_force(spark):
    rng = random.Random(2)
    uniform = sharding.HashTree.uniform(3, 4, 2)
    uneven = sharding.HashTree(tuple((i // 6, i // 2 % 3, i, rng.uniform(0.2, 5)) for i in range(17)))
    keys = [None, -5, *range(300), 1 << 62]
    for tree in (uniform, uneven):
        rows = [(k, rng.choice(["a", "é" * 50, None, ""])) for k in keys + keys[:40]]
        got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), tree).collect()
        grown = tree.grow()
        want = sorted((str(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), brute_shard(k, tree), brute_shard(k, grown)) for k, t in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
        for s in {r.shard for r in got}:
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))


def test_isotonic_equals_its_definition():
    """Of each point the largest, over starts before it, of the smallest mean up to an end after it."""
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 12)
        counts = [rng.randint(1, 5) for _ in range(n)]
        sums = [rng.randint(0, c) for c in counts]
        mean = lambda a, b: sum(sums[a:b]) / sum(counts[a:b])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        centres, levels = quality_classifier.isotonic([float(i) for i in range(n)], counts, sums)
        # points of one level are one block, at their mean
        distinct = sorted(set(np.round(want, 9)))
        assert np.round(levels, 9).tolist() == distinct
        where = [np.average([i for i in range(n) if round(want[i], 9) == x], weights=[counts[i] for i in range(n) if round(want[i], 9) == x]) for x in distinct]
        assert centres.tolist() == pytest.approx(where)


def test_weights_are_the_ridge_solution(spark):
    rng = np.random.RandomState(3)
    values, labels = rng.normal(0, 1, (200, len(quality_classifier.NAMES))), rng.randint(0, 2, 200).astype(float)
    training = spark.createDataFrame([(v.tolist(), y) for v, y in zip(values, labels.tolist())], "statistics array<double>, label double").repartition(5)
    model = quality_classifier.fit(training, quality_classifier.Kernel(features=20))
    mapped = model.map(values)
    assert np.allclose(model.mean, values.mean(axis=0), atol=1e-6) and np.allclose(model.spread, values.std(axis=0), atol=1e-6)
    penalty = np.eye(21)
    penalty[-1, -1] = 0
    assert np.allclose(model.weights, np.linalg.solve(mapped.T @ mapped + penalty, mapped.T @ labels), atol=1e-4)


def test_features_approximate_a_gaussian_kernel():
    kernel = quality_classifier.Kernel(features=20000)
    zero, n = np.zeros(len(quality_classifier.NAMES)), len(quality_classifier.NAMES)
    model = quality_classifier.Model(zero, zero + 1, np.zeros(1), zero[:1], zero[:1], kernel)
    values = np.random.RandomState(5).normal(0, 1, (6, n))
    products = model.map(values)[:, :-1] @ model.map(values)[:, :-1].T
    apart = ((values[:, None] - values[None]) ** 2).sum(axis=2)
    assert np.abs(products - np.exp(-apart / (2 * kernel.width**2))).max() < 0.05


def test_no_message_is_lost(spark):
    long = "very " * 60000
    rows = [(None, 0, "user", "a1"), (None, 0, "user", "a2"), (None, 0, "user", "a2"), (None, 1, "assistant", None), (1, 0, "user", long), (1, 1, "assistant", "b1"), (1, None, "user", "c1"), (2, 3, "tool", "d1"), (3, 0, None, ""), (4, 7, "assistant", 'e"1\n'), (10, 2, "user", "f1"), (10, 2, "user", None)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, json string")
    calls, results, others = chat_format.from_conversations(messages)
    schemas = spark.createDataFrame([("reply", "text", "STRING", True)], "name string, field string, kind string, required boolean")
    got = chat_format.linked_calls(calls, results, schemas).unionByName(chat_format.plain_messages(others)).collect()
    said = [json.loads(r.json) for r in got]
    texts = sorted(str(x.get("content", x.get("result", (x.get("arguments") or {}).get("text") if isinstance(x.get("arguments"), dict) else None))) for x in said)
    for t in ["a1", "a2", "c1", "d1", 'e"1\n', ""]:
        assert t in texts, t
    assert any(long in r.json for r in got) and any('"b1"' in r.json for r in got)
    assert len(got) == len(rows) - sum(r.status in ("linked", "early") for r in got) and {r.status for r in got} >= {"message", "repeated_call", "no_call", "linked"}
    assert chat_format.linked_calls(calls.where("false"), results.where("false"), schemas).collect() == []
    assert re.fullmatch(r"[a-z_]+", got[0].status) and messages.select(F.count("*")).first()[0] == len(rows)
