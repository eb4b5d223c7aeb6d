"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from quotelens.llm import spelling_variants as sv


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    forms = {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        forms[w] = (others[0] if others and n[others[0]] >= 5 * n[w] else None, len(others))
    out = []
    for w, (form, count) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_whole_texts(spark, monkeypatch):
    rng = random.Random(2)
    known = ["Wonderful", "wonderful", "ÀÉÎöüß", "short", "overlong" * 30, "mixed×sign", "naïveté", "ABCDEF", "abcdef"]
    docs = [(k if k % 7 else None, None if k % 11 == 3 else "" if k % 11 == 4 else rng.choice([" ", "1", "\n", "漢"]).join(rng.choices(known, k=rng.randint(1, 80)))) for k in range(150)]
    monkeypatch.setattr(sv, "STEP", 50)
    df = spark.createDataFrame([(k, t, 3) for k, t in docs], "doc_id long, text string, n int").repartition(3)
    assert {r["word"]: r["n"] for r in sv.word_counts(df).collect()} == brute_counts(docs)
    assert sv.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_long_text_is_read_in_steps(monkeypatch):
    monkeypatch.setattr(sv, "STEP", 10)
    text = "Abcdefghijklmnop qrstuv " * 20 + "x" * 100 + "é" * 30
    assert [r for runs in sv.runs_of(text) for r in runs] == re.findall("[a-zÀ-ÿ]+", text.lower())
    assert list(sv.runs_of("")) == []


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_near_words_and_roots(spark, tile):
    rng = random.Random(tile)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.choice([5, 6, 25, 30, 125, 700, 4000]) for _ in range(250)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaaaaa": 3125, "aaaaaaaaaaa": 15625}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows(sv.variants(df, tile=tile)) == brute(words)


def test_large_group_and_long_words(spark):
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choices("abcdefgh", k=6)): rng.randint(5, 60) for _ in range(600)}
    words |= {"y" * 3000 + "a": 5, "y" * 3000 + "b": 30, "y" * 3000: 7, "y" * 1500 + "z" + "y" * 1500: 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows(sv.variants(df, tile=64)) == brute(words)


def test_no_words(spark):
    assert rows(sv.variants(spark.createDataFrame([], "word string, n long"))) == []


def test_dense_rows():
    left, right, lengths = sv.code_points(pa.array(["abc", "é", "zz"]))
    assert left.tolist() == [[97, 98, 99], [233, 0, 0], [122, 122, 0]] and right.tolist() == [[97, 98, 99], [0, 0, 233], [0, 122, 122]] and lengths.tolist() == [3, 1, 2]
