import random
import re

from quotelens.llm.near_dedup import components, near_duplicates

SCHEMA = "text string, doc_id long, bucket string, id int"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), doc == min(ids, default=None)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 3, 5, 6, 12, 60, 200]))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"X{rng.randint(0, 99)}"
            rows.append((len(rows), rng.choice([" ", "\n", "\x0b "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (None, "Only Here é"), (None, None), (503, rows[9][1].upper()), (4, rows[4][1])]
    docs = spark.createDataFrame([(t, d, "b", 1) for d, t in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_large_family_of_which_only_neighbours_are_alike(spark):
    """A chain: each text is like the next one only, so a hub alone finds few of the links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[3 * i : 3 * i + 90])) for i in range(60)]
    docs = spark.createDataFrame([(t, d, "b", 1) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55)], "a int, b int")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(1, 31)} | {(55, 50), (60, 50)}
