"""Sharding, mixing, quality rules, extraction, decontamination, classifier and chats against plain Python, and odd inputs."""

import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotelens.llm import chat_format, decontamination, html_extraction, mixing, quality_classifier, quality_rules, sharding

ODD = [("a b", 1, "s", 5), (None, 2, None, 5), ("", 3, "s", 5), ("a b", 1, "s", 5), ("x " * 30000, None, "t", 5), ("é 漢\n字", 9, None, None)]
SCHEMA = "text string, doc_id long, source string, size int"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shards(spark, tree, n=4000):
    rows = spark.range(n).select(F.col("id"), sharding.shard_of(F.col("id"), tree).alias("s")).collect()
    return {r[0]: r[1] for r in rows}


def test_shards_follow_weights_and_grow_into_the_new_one_only(spark):
    tree = sharding.HashTree.uniform(3, 4, 2)
    before, after = shards(spark, tree), shards(spark, tree.grow())
    counts = Counter(before.values())
    assert len(counts) == 24 and max(counts.values()) < 2 * min(counts.values())
    moved = {k for k in before if before[k] != after[k]}
    assert moved and {after[k] for k in moved} == {24} and abs(len(moved) - 4000 / 25) < 60
    heavy = sharding.HashTree(tuple((*leaf[:3], 3.0 if leaf[2] == 5 else 1.0) for leaf in tree.leaves))
    changed = shards(spark, heavy)
    region = {leaf[2]: leaf[:2] for leaf in tree.leaves}
    for k in before:
        if before[k] != changed[k]:  # only within, or into, the subtrees whose weights changed
            assert region[changed[k]][0] == region[5][0]
            assert region[before[k]][0] != region[5][0] or changed[k] == 5 or region[changed[k]] == region[5]


def test_shard_rows(spark, odd, empty):
    tree = sharding.HashTree.uniform(2, 1, 2)
    got = sharding.shard_rows(odd, tree).collect()
    assert len(got) == len(ODD) and sharding.shard_rows(empty, tree).collect() == []
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t, d, *_ in ODD)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def brute_mix(rows):
    sizes = [len(re.findall(WORD, t or "")) for t, *_ in rows]
    by = {}
    for (_, _, s, *_), n in zip(rows, sizes):
        by[s] = by.get(s, 0) + n
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), 1.5 * sum(sizes)
    while left:
        unit = budget / sum(weight[s] for s in left)
        full = {s for s in left if unit * weight[s] >= 2 * by[s]}
        for s in full or left:
            target[s] = 2.0 * by[s] if full else unit * weight[s]
            budget -= target[s]
        left -= full or left
    return by, target


def test_mix_meets_targets(spark, odd, empty):
    rng = random.Random(2)
    rows = [(" ".join("w" * rng.randint(0, 40)), i, rng.choice(["a", "a", "a", "b", "é", "z", None]), 0) for i in range(500)] + ODD
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, mixing.words_in(F.col("text")))
    got = mixed.select("row.*", F.col("size").alias("words"), "source_size", "target", "taken", "again", "position", "position_again").collect()
    by, target = brute_mix(rows)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.again <= r.words and 0 <= r.taken - r.again <= r.words
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position < 1)
        assert (r.position_again is None) == (r.again == 0) and (r.position_again is None or r.position < r.position_again < 1)
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 1
    # until any t, a source gives the words that its schedule asks for, but for one document
    slope = {s: (0.5, 0.0, -0.5)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    uses = [(s, p, n) for r in got for s, p, n in ((r.source, r.position, r.taken - r.again), (r.source, r.position_again, r.again)) if n]
    assert len({s for s in by if target[s] > by[s]}) > 1
    for t in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
        for s in by:
            asked = target[s] * (t + slope[s] * (t * t - t))
            given = sum(n for u, p, n in uses if u == s and p < t)
            assert -1 <= given - asked <= 1 + max(n for u, _, n in uses if u == s), (t, s)
    # every use is a row, in order of training, cut to its words
    placed = mixing.passes(mixed).select("row.*", "position").collect()
    assert [r.position for r in placed] == sorted(p for _, p, _ in uses)
    counts = Counter((r.source, r.position, len(re.findall(WORD, r.text))) for r in placed)
    assert counts == Counter(uses) and all(any((r.text or "").startswith(p.text) for r in rows_of[p.doc_id]) for rows_of in [by_id(got)] for p in placed)
    assert mixing.mix(empty, mixing.words_in(F.col("text"))).collect() == []


def by_id(rows):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_quality_rules_on_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(odd).collect()}
    assert got == {(1, 2, True, False), (2, 0, True, False), (3, 0, True, False), (None, 30000, True, False), (9, 3, True, False)}
    assert quality_rules.quality_rules(empty).collect() == []


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randint(0, rng.choice([3, 30, 3000]))}" for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            cut = words[: rng.randint(0, 30)]
            words += cut
        texts.append("".join(w + rng.choice([" ", "\n", " # "]) for w in words))
    docs = spark.createDataFrame([(t, i, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(WORD, t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        longest, inside = 0, set()
        for a in range(len(w)):
            for b in range(a):
                k = 0
                while a + k < len(w) and w[a + k] == w[b + k]:
                    k += 1
                longest = max(longest, k)
                if k >= 8:
                    inside |= {*range(a, a + k), *range(b, b + k)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        r = got[i]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed)
        assert (r.covered_words, r.longest_repeat, r.kept) == (len(inside), longest, not failed and len(inside) <= 0.2 * len(w) and longest <= 60)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site, name.</header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies, so accept. Now.</div><article><h1>Title &amp; more</h1><p>First paragraph,  with&nbsp;words; and more.<p><b>Bold.<br></b>Then
text.</p><div class="ad">Buy this, now. Really.</div><ul><li>one</li><li>two</li></ul></article><aside>Related, things. And more.</aside>
<section id="comments"><p>Great article, thanks. I liked it, a lot.</p></section><form>Name <input></form><script>if (a<b) x="</p>"</script><footer>(c) all rights, reserved.</footer></body></html>"""


def test_extraction(spark):
    want = "Title & more\n\nFirst paragraph, with words; and more.\n\nBold. Then text.\n\none\n\ntwo"
    assert html_extraction.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", "<p>" * 3000 + "a" + "<b <", "x"), (5, "u", "plain, text only. Yes.", "x")]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and [r.n_chars for r in got] == [len(r.text) for r in got]
    assert {(r.page_id, r.text) for r in got if r.page_id != 4} == {(1, want), (2, ""), (None, ""), (5, "plain, text only. Yes.")}
    assert html_extraction.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


ITEMS = [(1, "Anna has 12 apples and gives 3 apples to her brother Tom. How many apples does Anna have left today?"), (2, "short item only"), (3, None), (4, ""), (None, "quite another question about seven green rivers and hills")]


def test_decontamination(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [
        ("Before it. Mia has 7 apples and gives 2 apples to her brother Bob. How many apples does Mia have left today? After.", 1),
        ("Mia has 7 apples and gives 2 apples to her brother Mia. How many apples does Mia have left today?", 2),  # one name for two
        ("MIA??? has 7 apples;;; and gives 2 apples to her *** brother Bob", 3),
        ("a SHORT, item: only yes", 5),
        (None, 6),
        ("", 7),
        ("quite another question about seven green rivers and hills", None),
        ("nothing of the kind is in here at all, not a word of it", 8),
        ("x " * 20000 + ITEMS[0][1], 9),
    ]
    got = decontamination.contaminated(spark.createDataFrame([(t, d, "s", 1) for t, d in docs], SCHEMA), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (5, 2), (None, None), (9, 1)}
    assert decontamination.contaminated(empty, items).collect() == []
    assert decontamination.contaminated(spark.createDataFrame([("a", 1, "s", 1)], SCHEMA), items.where("false")).collect() == []


def test_shuffled_like_broadcast(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(ITEMS[0][1], 1, "s", 1), ("short item only", 2, "s", 1)], SCHEMA)
    few = decontamination.Templates(broadcast=0)
    assert sorted(map(tuple, decontamination.contaminated(docs, items, templates=few).collect())) == sorted(map(tuple, decontamination.contaminated(docs, items).collect()))


def test_classifier_learns_and_leaves_out(spark, odd, empty):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["tree", "house", "river", "walks", "the", "a", "green"]) + rng.choice(["", "", "s"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "###", "BUY", "NOW!!"]) for _ in range(80))
    rows = [((good if i % 3 else bad)(), i, "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(7, None, 0), (9999, 1, 0), (None, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held) and all(0 <= r.score <= 1 for r in got)
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality_classifier.quality_scores(docs, wrong).collect())) == sorted(map(tuple, got))  # held-out labels teach nothing
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).collect() == []


def test_isotonic_rises():
    centres, levels = quality_classifier.isotonic([0.0, 1.0, 2.0, 3.0], [1, 1, 2, 1], [0, 1, 1, 1])
    assert list(levels) == [0, pytest.approx(2 / 3), 1] and list(centres) == [0, pytest.approx(5 / 3), 3]


def test_linked_calls(spark, monkeypatch):
    calls = [
        ("a", "1", 0, "add", '{"y": 2, "x": 1}'), ("a", "2", 2, "add", '{"x": "${1}", "y": 3}'), ("a", "3", 4, "add", '{"x": 1, "z": 0}'), ("a", "4", 6, "nope", "{bad"), ("a", "5", 8, "add", '{"x": 1, "y": "${6}"}'), ("a", "6", 9, "add", '{"x": 1, "y": "${5}"}'),
        ("a", "7", 10, "add", '{"x": 1, "y": "${9} ${7}"}'), (None, "1", 0, "add", '{"y": 2.0, "x": 1}'), ("a", "1", 20, "add", "{}"), ("a", None, 1, "add", "{}"),
    ]
    results = [("a", "1", 1, "3"), ("a", "2", 1, 'said "é"\n'), ("a", "8", 5, "stray"), (None, "1", 3, None), ("a", "1", 30, "late"), ("b", None, 1, "x")]
    schemas = [("add", "x", "BIGINT", True), ("add", "y", "BIGINT", True)]
    frames = spark.createDataFrame(calls, "conv string, call_id string, turn int, name string, arguments string"), spark.createDataFrame(results, "conv string, call_id string, turn int, content string"), spark.createDataFrame(schemas, "name string, field string, kind string, required boolean")
    rows = chat_format.linked_calls(*frames).collect()
    got = {(r.conv, r.call_id): r for r in rows if r.after_turn is not None or r.status in ("no_call", "circular")}
    assert len(got) == 9
    # every other message has a row of its own
    assert sorted((r.status, r.turn, r.json) for r in rows if (r.conv, r.call_id) not in got or r is not got[(r.conv, r.call_id)]) == [
        ("call_without_id", 1, '{"arguments":{},"name":"add"}'), ("repeated_call", 20, '{"arguments":{},"call_id":"1","name":"add"}'),
        ("repeated_result", 30, '{"call_id":"1","result":"late"}'), ("result_without_id", 1, '{"result":"x"}'),
    ]
    assert got[("a", "8")].json == '{"call_id":"8","result":"stray"}'
    assert {k[1]: (r.after_turn, r.step, r.status) for k, r in got.items() if k[0]} == {"1": (0, 0, "linked"), "2": (2, 0, "early"), "3": (4, 0, "no_result"), "4": (6, 0, "no_result"), "5": (None, None, "circular"), "6": (None, None, "circular"), "7": (10, 0, "no_result"), "8": (None, None, "no_call")}
    assert got[("a", "1")].errors == ["call_id: repeated call", "call_id: repeated result"] and got[("a", "2")].errors == ["x: STRING for BIGINT"]
    assert got[("a", "3")].errors == ["y: missing", "z: not in the schema"] and got[("a", "4")].errors == ["arguments: not an object"]
    assert got[("a", "2")].json == '{"arguments":{"x":"${1}","y":3},"call_id":"2","name":"add","result":"said \\"é\\"\\n"}'
    assert json.loads(got[("a", "4")].json)["arguments"] == "{bad" and got[(None, "1")].status == "linked"
    nothing = [f.where("false") for f in frames]
    assert chat_format.linked_calls(*nothing).collect() == []
    monkeypatch.setattr(chat_format, "FEW", 0)
    assert sorted(map(str, chat_format.linked_calls(*frames).collect())) == sorted(map(str, rows))


def test_calls_come_after_what_they_refer_to(spark):
    rng = random.Random(5)
    for _ in range(3):
        ids = list(range(25))
        rng.shuffle(ids)  # references go from a place to earlier places, but turns are in any order
        refers = {c: rng.sample(ids[:k], min(k, rng.randint(0, 2))) for k, c in enumerate(ids)}
        calls = spark.createDataFrame([("a", str(c), c, "t", json.dumps({"x": " ".join(f"${{{r}}}" for r in refers[c])})) for c in ids], "conv string, call_id string, turn int, name string, arguments string")
        place = {r.call_id: (r.after_turn, r.step) for r in chat_format.ordered(calls).collect()}
        assert len(place) == 25 and all(place[str(c)] > place[str(r)] for c in ids for r in refers[c])
