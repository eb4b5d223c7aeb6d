import hashlib
import random
import re

from quotelens.llm.substring_dedup import Limits, SuffixAutomaton, substring_dedup

SMALL = Limits(length=8, gram=3, reference=20, probe=40)
SCHEMA = "text string, doc_id long, holder string, class1 int"


def brute(rows, length):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), words in zip(rows, texts):
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            first[w] = min(first.get(w, 1 << 70), 1 << 63 if doc is None else doc)
    out = []
    for (doc, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (1 << 63 if doc is None else doc):
                gone |= set(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(6, 25))] for k in range(5)] + [["x"] * 20, ["a", "b"] * 12]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            words += p[a : len(p) - rng.randint(0, 4)] + [f"u{rng.randint(0, 400)}é" for _ in range(rng.randint(0, 6))]
        rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200 + i, rows[5][1]) for i in range(5)] + [(None, rows[7][1]), (None, None), (301, None), (302, ""), (7, rows[7][1]), (9, rows[8][1]), (303, " ".join(f"l{i % 700}" for i in range(5000)))]
    docs = spark.createDataFrame([(t, d, "h", 1) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, substring_dedup(docs, limits=SMALL).collect()), key=str)
    want = brute(rows, 8)
    assert got == want
    assert sum(x[2] for x in want) > 500


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automaton_matches_by_owner():
    automaton = SuffixAutomaton()
    last = automaton.add([1, 2, 3, 4, 5], 7)
    automaton.add([2, 3, 4, 9], 3, last)
    automaton.finish()
    assert automaton.held([0, 2, 3, 4, 5], 3, 7) == [1]
    assert automaton.held([2, 3, 4, 5], 4, 7) == []
    assert automaton.held([2, 3, 4, 5], 4, 8) == [0]
