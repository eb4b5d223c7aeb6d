"""Regular sequences, for which sums of powers collide whatever their base: words, lines and windows that differ must stay apart."""

import hashlib

import pytest
from test_near_dedup import brute as brute_groups
from test_substring_dedup import brute as brute_removal

from quotelens.llm import near_dedup, quality_rules, substring_dedup


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


WORDS = thue_morse(1024, "xy"), thue_morse(1024, "yx")
TEXTS = [" ".join([f"w{i}" for i in range(30)] + [w] + [f"w{i}" for i in range(31, 61)]) for w in WORDS]


def test_near_duplicates(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5 + i, w) for i, w in enumerate(WORDS)]
    # a text of few words, each one of the two, in the same order of kinds
    rows += [(10 + k, " ".join("ab"[(bin(i).count("1") + k) % 2] for i in range(64))) for k in range(2)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_groups(rows) and sum(r[3] for r in got if r[0] < 10) == 4


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, "\n".join([*WORDS, WORDS[0] + " "])), (2, "\n".join([WORDS[0], "", " ", WORDS[0], "a"]))], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.quality_rules(docs).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("kind, keys", [("long", [(1 << 63) - 2, (1 << 63) - 1, None]), ("string", ["a", "é", None])])
def test_substring_removal(spark, kind, keys):
    rows = [*zip(keys, [TEXTS[0], TEXTS[1], TEXTS[1] + " more"])]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    kept = [TEXTS[0], TEXTS[1], "more"]
    assert sorted(map(tuple, got), key=str) == sorted([(k, len(t.split()), len(t.split()) - len(s.split()), hashlib.sha256(s.encode()).hexdigest()) for (k, t), s in zip(rows, kept)], key=str)


def test_one_long_holder_is_cut_into_pieces(spark):
    limits = substring_dedup.Limits(length=8, gram=3, reference=10, probe=40)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[3:250])), (3, " ".join(words[95:140] + ["x"] + words[7:15] + words[299:])), (None, " ".join(words[40:60])), (None, " ".join(words[40:60]))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), limits=limits).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows, 8)
