"""The written index: what outlives a job, plans that leave the canon where it lies, hot keys in parts, and ways of matching against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quotelens.functions.profiles import LATIN, Profile
from quotelens.operators import align, canon_index, match, suggest, verify
from quotelens.sources import corpus

VOWELS = Profile("vowels", LATIN.form, "aeiou")
SCHEMA = "group_id int, ord int, group_name string, text string"


def passages(spark, texts, profile=VOWELS, per_group=10):
    return corpus.passages_of(spark.createDataFrame([(i // per_group, i % per_group + 1, f"g{i // per_group}", t) for i, t in enumerate(texts)], SCHEMA), profile)


def random_texts(n, seed, least=4, most=12):
    rng = random.Random(seed)
    known = ["the", "of", "a", "io", "u", "stone", "stoen", "river", "rivers", "nation", "ntion", "gate", "gt", "under", "house", "hous", "seven"]
    return [" ".join(rng.choices(known, weights=[9, 9, 5, 4, 4] + [1] * 12, k=rng.randint(least, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def canon(spark):
    return passages(spark, random_texts(120, 1)).cache()


def edited(words, rng):
    words = list(words)
    for _ in range(rng.randint(0, 2)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["zzz"], [words[k], "yyy"], [words[k].replace("o", "", 1)], [words[k][:2], words[k][2:]] if len(words[k]) > 2 else ["of"]])
        if not words:
            words = ["the", "of"]
    if len(words) > 2 and rng.random() < 0.4:
        k = rng.randrange(len(words) - 1)
        words[k : k + 2] = [words[k] + words[k + 1]]
    return [w for w in words if w]


@pytest.fixture(scope="module")
def asked(spark, canon):
    rng = random.Random(3)
    rows = [r.t1_words for r in canon.collect()]
    texts = []
    for i in range(80):
        words = rng.choice(rows)
        at = rng.randrange(max(1, len(words) - 3))
        texts.append((i, " ".join(edited(words[at : at + rng.randint(2, 9)] or words, rng))))
    return match.with_words(spark.createDataFrame([*texts, (900, None), (901, ""), (902, "one")], "cand_id int, text string"), VOWELS).cache()


def alike(a, b, same):
    """Looked up by at most one edit."""
    if a == b:
        return True
    return same(a, b) and not (abs(len(a) - len(b)) > 1)


def ends_fit(cited, words, same):
    heads = ["".join(cited[:k]) for k in range(1, min(3, len(cited)) + 1)]
    tails = ["".join(cited[-k:]) for k in range(1, min(3, len(cited)) + 1)]
    return all(any(alike(f, w, same) for f in forms for w in words) for forms in (heads, tails))


def test_soft_runs_and_near_passages_equal_all_pairs(spark, canon, asked):
    same, rows, cited = align._same("aeiou"), canon.collect(), [r for r in asked.collect() if r.cited_words and len(r.cited_words) > 1]
    pairs = [(c, p) for c in cited for p in rows if ends_fit(c.cited_words, p.t1_words, same)]
    soft = {(c.cand_id, p.group_id, p.ord) for c, p in pairs if align.first_alignment(p.t1_words, c.cited_words, same)}
    found = match.softly_anchored(asked, canon, VOWELS, whole=True).where(align.soft_span("aeiou")("canon", "cited_words")["start"].isNotNull())
    assert {(r.cand_id, r.group_id, r.ord) for r in found.collect()} == soft and len(soft) > 40
    few = lambda n: max(2, -(-n // 4))
    near = {(c.cand_id, p.group_id, p.ord) for c, p in pairs if len(c.cited_words) <= len(p.t1_words) + few(len(c.cited_words)) and min(align.distances(c.cited_words, p.t1_words, same, True)[-1]) <= few(len(c.cited_words))}
    edits = match.allowed_edits(F.size("cited_words"), True)
    found = match.softly_anchored(asked, canon, VOWELS, edits=edits).where(align.window_distance("aeiou")("cited_words", "canon", edits).isNotNull())
    assert {(r.cand_id, r.group_id, r.ord) for r in found.collect()} == near and len(near) > len(soft)


def test_plans_leave_the_canon_where_it_is(spark, canon, asked, monkeypatch):
    monkeypatch.setattr(canon_index, "BROADCAST", 0)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = canon_index.kept_index(canon, VOWELS)
        for df in (match.exact(asked, index), canon_index.probed(asked.select("cand_id", F.array(canon_index.option(F.transform("cited_words", lambda w: canon_index.key("w", w)))).alias("options")), index)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            for i, line in enumerate(lines):
                if "quotelens_" not in line or "FileScan" not in line:
                    continue
                # up from the scan to the join, through the operators above it alone, nothing is shuffled
                depth = lambda x: len(x) - len(x.lstrip(" :+-"))
                here, above = depth(line), []
                for other in reversed(lines[:i]):
                    if depth(other) < here:
                        here = depth(other)
                        above.append(other)
                        if "Join" in other:
                            break
                assert "Join" in above[-1] and not any("Exchange" in a for a in above), plan
            assert "FileScan" in plan and "Bucketed: true" in plan
        assert {tuple(r) for r in match.exact(asked, index).select("cand_id", "group_id", "ord").collect()} == {tuple(r) for r in match.exact(asked, canon).select("cand_id", "group_id", "ord").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_index_is_made_once(spark, canon, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/kept"
    first = canon_index.kept_index(canon, VOWELS, folder)
    monkeypatch.setattr(canon_index, "_write", lambda *_: pytest.fail("made again"))
    # the same rows in other order and another frame
    again = canon_index.kept_index(canon.orderBy(F.desc("ord")).repartition(3), VOWELS, folder)
    assert again.path == first.path and again.postings.count() == first.postings.count() > 0
    newer = canon.withColumn("text", F.concat("text", F.lit(" x")))
    monkeypatch.undo()
    assert canon_index.kept_index(newer, VOWELS, folder).path != first.path
    assert canon_index.open_index(spark, f"{folder}/none") is None


def test_hot_keys_lie_in_parts(spark, monkeypatch):
    monkeypatch.setattr(canon_index, "PART", 8)
    hot = passages(spark, ["the " + t for t in random_texts(300, 5)])
    index = canon_index.kept_index(hot, VOWELS, None)
    most = index.postings.groupBy("key", "part").count().agg(F.max("count")).first()[0]
    assert index.counts.where("key = 'wthe'").first().often == 300 and most < 30
    common = match.with_words(spark.createDataFrame([(1, "the of"), (2, "of the")], "cand_id int, text string"), VOWELS)
    want = {(c, r.group_id, r.ord) for c, x in ((1, "the of"), (2, "of the")) for r in hot.collect() if f" {x} " in f" {r.t1} "}
    assert {(r.cand_id, r.group_id, r.ord) for r in match.contiguous(common, index).collect()} == want != set()


def test_chains_where_the_first_pick_is_too_far(spark):
    texts = ["alpha beta gamma delta", *[f"filler number {i} is here" for i in range(45)], "alpha beta gamma delta", "omega psi chi phi"]
    far = passages(spark, texts, LATIN, per_group=100)
    rows = [(1, "beta gamma * psi chi"), (2, "gamma delta * omega"), (3, "psi chi * beta gamma"), (4, None), (5, "*"), (6, "beta gamma * nothing here")]
    got = {r.cand_id: (r.group_id, r.ords) for r in verify.segment_matches(spark.createDataFrame(rows, "cand_id int, text string"), far, LATIN).collect()}
    assert got == {1: (0, [47, 48]), 2: (0, [47, 48])}


def test_nulls_everywhere(spark, canon):
    schema = "cand_id int, text string, high boolean, claimed_group int, ords array<int>, range_ords array<int>"
    rows = [(1, None, True, 1, [1], None), (2, "", True, 1, [1, 2], [1, 2, 3]), (3, "the of", None, None, None, None), (4, None, False, None, None, None), (5, "the of", True, 1, None, None), (6, "x" * 5000, True, 99, [1], None), (None, "seven of", True, 1, [1], None)]
    got = {r.cand_id: r.verdict for r in verify.memoized(spark.createDataFrame(rows, schema), canon, VOWELS).collect()}
    assert got[1] == got[2] == got[6] == "red" and 4 not in got
    none = spark.createDataFrame([(1, None), (2, "")], "cand_id int, text string")
    assert verify.near_matches(none, canon, VOWELS).collect() == verify.alternates(none, canon, VOWELS).collect() == suggest.suggestions(none, canon, VOWELS).collect() == []
    lists = spark.createDataFrame([(None, ["a"], 1), (["a"], None, 1), (["a"], ["a"], None), (["a", None], ["a"], 1), ([], [], 1)], "a array<string>, b array<string>, n int")
    assert [r.x for r in lists.select(align.window_distance("")("a", "b", "n").alias("x")).collect()] == [None, None, None, 1, None]
    parts = spark.createDataFrame([(None, [["a"]]), (["a"], None), (["a"], [["a"]]), (["a"], [])], "a array<string>, b array<array<string>>")
    assert [r.x for r in parts.select(align.ordered_segments("")("a", "b").alias("x")).collect()] == [False, False, True, True]


def test_suggestion_tiers_and_limits(spark):
    p = passages(spark, ["seven gates under the river", "sevengates under the rivers flow", "seven gates zzz the river bed", "seven gates under", *[f"seven gates under number{i}" for i in range(9)]])
    asked = spark.createDataFrame([(1, "seven gates under the riv"), (2, "seven gates undr"), (3, "seven gates under qq"), (4, "sev"), (5, "qq ww")], "cand_id int, text string")
    got = {}
    for r in suggest.suggestions(asked, p, VOWELS, limit=0, least_words=1).collect():
        got.setdefault(r.cand_id, []).append((r.rank, r.tier, r.group_id, r.ord))
    tiers = lambda c: [t for _, t, _, _ in sorted(got[c])]
    assert sorted(got[1])[:2] == [(0, 0, 0, 1), (1, 1, 0, 2)] if (1, 1, 0, 2) in got[1] else sorted(got[1])[0] == (0, 0, 0, 1)
    assert set(tiers(2)) <= {1, 2} and 1 in tiers(2) and tiers(3) and tiers(3)[0] == 0 and len(tiers(4)) == 13 and 5 not in got
    few = suggest.suggestions(asked.where("cand_id = 3"), p, VOWELS, limit=2).collect()
    assert sorted((r.rank, r.tier) for r in few) == [(0, 0), (1, 0)]
