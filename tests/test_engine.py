"""Normalisation, alignment, references, extraction, verdicts, findings and corrections on small cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quotelens.functions import labels
from quotelens.functions.profiles import ARABIC, LATIN, split_vocative
from quotelens.operators import align, corrections, extract, findings, match, references, suggest, verify
from quotelens.sources import corpus, pages

OPENING = "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_arabic_form(spark):
    form = lambda t: one(spark, ARABIC.form(F.lit(t)))
    assert form(OPENING) == form("بسم الله الرحمان  الرحيم ")
    assert form("مؤمن قرأ سئل") == form("مءمن قرء سءل")
    assert form("هدى رحمة") == "هدي رحمه"
    assert one(spark, ARABIC.skeleton(F.lit("رحمان"))) == "رحمن"
    assert one(spark, LATIN.form(F.lit("  Été, 2nd—Été!"))) == "été 2nd été"


def test_vocative(spark):
    joined = "ي" + chr(0x64E) + chr(0x670) + "بني"
    assert one(spark, split_vocative(F.lit(joined))) == "يَا بني"


def test_same_word_equals_its_definition(spark):
    """The column form against deleting and replacing letters by hand."""
    rng = random.Random(6)
    same = align._same(ARABIC.drift)
    letters = ARABIC.drift + "بم"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    rows = [(word(), word()) for _ in range(3000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ARABIC.same_word(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == same(r.a, r.b) for r in got) and any(r.x and r.a != r.b for r in got)


def test_alignment_merges_and_prefers_single_words():
    same = align._same("")
    assert align.first_alignment("a b c d".split(), "b cd".split(), same) == (1, 4)
    assert align.first_alignment("a bc d".split(), "b c d".split(), same) == (1, 3)
    assert align.first_alignment("a b".split(), "b a".split(), same) is None
    edits = align.trace("a x c e".split(), "a b c d e".split(), same)
    assert [e["op"] for e in edits] == ["keep", "sub", "keep", "missing", "keep"]


def test_longest_run_and_labels(spark):
    run = align.longest_run("")
    rows = [("a b a b c".split(), "a b c d".split()), ("a b".split(), ["x"]), (None, ["x"])]
    got = spark.createDataFrame(rows, "c array<string>, t array<string>").select(run("c", "t").alias("r")).collect()
    assert [tuple(r.r) for r in got] == [(2, 3), (None, None), (None, None)]
    label = lambda m, c: one(spark, labels.in_claimed_spelling(F.lit(m), F.lit(c), ARABIC.form))
    assert label("إبراهيم:3", "(أبراهيم:4)") == "أبراهيم:3" and label("البقرة:3", "(شيء:3)") == "البقرة:3" and label("البقرة:3", None) == "البقرة:3"


def test_window_distance_is_the_best_window():
    rng = random.Random(8)
    same = align._same("")
    for _ in range(300):
        h, n = [[rng.choice("abc") for _ in range(rng.randint(1, 7))] for _ in range(2)]
        best = min(align.distances(n, h[i:j], same, False)[-1][-1] for i in range(len(h) + 1) for j in range(i, len(h) + 1))
        assert min(align.distances(n, h, same, True)[-1]) == best


@pytest.fixture(scope="module")
def canon(spark):
    rows = [(1, 1, "One", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, 2, "One", "lambda mu nu xi omicron pi rho sigma"), (2, 1, "Two", "tau upsilon phi chi psi omega alpha mu"), (2, 2, "Two", "short one")]
    return corpus.passages_of(spark.createDataFrame(rows, "group_id int, ord int, group_name string, text string"), LATIN).cache()


CASES = [
    ("Alpha beta gamma delta epsilon zeta eta theta iota kappa", True, None, None, "lightBlue", "exact"),
    ("beta, gamma delta", True, 1, [1], "green", "exact"),
    ("beta gamma delta", True, 2, [1], "orange", "orderedContiguous"),
    ("beta gamma delta", False, 2, [2], "yellow", "partial"),  # a run elsewhere counts as a quotation only if it is surely meant as one
    ("alpha beta gamma zzz epsilon zeta eta theta iota", True, 1, [1], "yellow", "partial"),
    ("zzz yyy", True, None, None, "red", "none"),
    ("zzz yyy", False, None, None, None, None),
    ("alpha beta...iota kappa", True, 1, [1], "green", "exact"),
    ("lambda mu nu xi omicron pi rho sigma", False, 2, [1], "orange", "exact"),
    ("alpha beta * xi omicron", True, None, None, "lightBlue", "orderedContiguous"),
    ("kappa lambda", True, 1, [1, 2], "green", "exact"),
    ("gamma", True, 2, [2], "orange", "partial"),
    ("gamma", False, None, None, "lightBlue", "partial"),
    ("alphabeta gamma delta", True, 1, [1], "green", "exact"),
    (None, True, None, None, "red", "none"),
]


def test_verdicts(spark, canon):
    rows = [(i, *c[:4], None) for i, c in enumerate(CASES)]
    asked = spark.createDataFrame(rows, "cand_id int, text string, high boolean, claimed_group int, ords array<int>, range_ords array<int>")
    got = {r.cand_id: (r.verdict, r.match_type) for r in verify.memoized(asked, canon, LATIN).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES) if c[4]}


def test_drifted_and_merged_ends_are_found_without_a_claim(spark):
    rows = [(1, 1, "ا", "قال موسي لقومه يا قوم اذكروا نعمه ربكم"), (1, 2, "ا", "كلام اخر لا شيء منه هناك ابدا")]
    arabic = corpus.passages_of(spark.createDataFrame(rows, "group_id int, ord int, group_name string, text string"), ARABIC)
    texts = ["قل موسي لقومه يا", "موسي لقومه ياقوم اذكروا", "لقو مه يا قوم", "موسي اذكروا لقومه نعمه", "قال مسي لقمه يا قوم"]
    asked = spark.createDataFrame([(i, t, True, None, None, None) for i, t in enumerate(texts)], "cand_id int, text string, high boolean, claimed_group int, ords array<int>, range_ords array<int>")
    got = {r.cand_id: r.verdict for r in verify.memoized(asked, arabic, ARABIC).collect()}
    assert got[0] == got[1] == got[2] == "lightBlue" and got[3] != "lightBlue" and got[4] == "lightBlue"


def test_near_match(spark, canon):
    red = spark.createDataFrame([(1, "alpha zzz gamma yyy epsilon zeta eta theta iota kappa"), (2, "kappa lambda mu zzz xi omicron pi rho sigma")], "cand_id int, text string")
    got = {r.cand_id: r for r in verify.near_matches(red, canon, LATIN).collect()}
    assert (got[1].group_id, got[1].first, got[1].last, got[1].distance) == (1, 1, 1, 2)
    assert [d.op for d in got[1].diff].count("sub") == 2
    assert (got[2].first, got[2].last, got[2].distance) == (1, 2, 1)


def test_references(spark):
    names = corpus.ref_names(spark, spark.createDataFrame([("البقرة", 2), ("الرحمن", 55)], "name string, group_id int"), ARABIC, corpus.VARIANTS)
    cited = [("(البقرة: ٢٥٥)", 2, [255], None), ("[سورة البقرة:1-3]", 2, [1, 2, 3], None), ("{البقر:5، 7}", 2, [5, 7], [5, 6, 7]), ("(الرحمان:1،2،3)", 55, [1, 2, 3], None), ("(البقرة:9-3)", None, None, None), ("(شيء:3)", None, None, None), ("no colon", None, None, None), (None, None, None, None)]
    got = references.resolved(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cited)], "i int, ref string"), names, ARABIC).orderBy("i").collect()
    assert [(r.ref, r.claimed_group, r.ords, r.range_ords) for r in got] == cited


def test_extraction(spark):
    body = "قال تعالى: {الحمد لله رب العالمين} (الفاتحة:2) وقوله: «مالك يوم الدين». ثم كلام طويل هنا {اهدنا الصراط المستقيم} وانتهى. 1 ولا الضالين ابدا (الفاتحة:7) 2 {قصير}"
    got = extract.candidates(spark.createDataFrame([(1, body), (2, None), (3, "no script")], "page_id int, text string")).orderBy("start").collect()
    assert [(r.text, r.ref, r.strategy, r.high) for r in got] == [
        ("الحمد لله رب العالمين", "الفاتحة:2", "leadInBraced", True),
        ("مالك يوم الدين", None, "secondaryLeadInBraced", True),
        ("اهدنا الصراط المستقيم", "الفاتحة:7", "explicitRefBackward", True),
        ("ولا الضالين ابدا", "الفاتحة:7", "shortFragmentRef", False),
    ]
    assert all(body[r.start : r.end] == r.text for r in got)


def extracted(spark, *bodies):
    got = extract.candidates(spark.createDataFrame(list(enumerate(bodies)), "page_id int, text string")).orderBy("page_id", "start").collect()
    return [[(r.text, r.ref, r.strategy, r.high) for r in got if r.page_id == i] for i in range(len(bodies))]


def test_extraction_rules(spark):
    got = extracted(
        spark,
        "قال تعالى: {ذلك الكتاب لا ريب فيه",  # a span without an end
        "قال تعالى: (البقرة:2) وغيره",  # a reference, no span
        "قوله تعالى: مالك يوم الدين (الفاتحة:4)",  # words after a lead-in, before a reference
        "{شريك} قوله {شريك} اي مشارك",  # one word after a secondary lead-in
        "انظر (الآيات 3: 1، 2، 3)",  # a list
        "{الحمد لله رب} ثم (الفاتحة:2) إلى قوله: {ولا الضالين ابدا} (الفاتحة:7)",  # two quotations, no range
        "كلمات اولى.\n\nمالك يوم الدين الواقعة:82) هنا",  # no opening bracket; a break before
    )
    assert got[0] == [("ذلك الكتاب لا ريب فيه", None, "leadInBraced", True)] and got[1] == []
    assert got[2] == [("مالك يوم الدين", "الفاتحة:4", "explicitRefBackward", True)]
    assert got[3] == [] and got[4] == []
    assert got[5] == [("الحمد لله رب", "الفاتحة:2", "explicitRefBackward", True), ("ولا الضالين ابدا", "الفاتحة:7", "explicitRefBackward", True)]
    assert got[6] == []


def test_long_texts_take_time_in_proportion():
    for body in ("كلمة طويلة هنا " * 2000, "كلمة {طويلة " * 2500, "كلمة (البقرة:5) طويلة " * 2000, "( " * 20000, " " * 50000, "كَلِمَة " * 5000 + ":1)"):
        began = time.time()
        assert sum(1 for _ in extract.marks_of(body)) >= 0
        assert time.time() - began < 2, body[:20]


def test_range_construct(spark):
    body = "{الحمد لله رب العالمين} إلى قوله: {ولا الضالين ابدا} (الفاتحة:2-7)"
    got = extract.candidates(spark.createDataFrame([(1, body)], "page_id int, text string")).collect()
    assert {(r.text, r.ref, r.strategy) for r in got} == {("الحمد لله رب العالمين", "الفاتحة:2-7", "rangeConstruct"), ("ولا الضالين ابدا", "الفاتحة:2-7", "rangeConstruct")}


def test_canon_of_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"meta":{"chaptersNames":{"chaptersNamesAr":{"ا":1}}},"suras":[{"index":"1","name":"ا","ayas":[{"index":"1","text":"' + OPENING + '"},{"index":"x","text":"y"}]}]}', encoding="utf-8")
    got = corpus.read_canon(spark, f"file://{tmp_path}/c.json").collect()
    assert [(r.group_id, r.ord, len(r.t1_words), r.ref) for r in got] == [(1, 1, 4, "ا:1")]
    (tmp_path / "d.json").write_text('{"suras":[]}')
    with pytest.raises(ValueError):
        corpus.read_canon(spark, f"file://{tmp_path}/d.json")


def test_passages_within_texts(spark, canon):
    texts = match.with_words(spark.createDataFrame([(1, "x lambda mu nu xi omicron pi rho sigma short one"), (2, "lambda mu nu xi omicron pi rho"), (3, "")], "k int, text string"), LATIN)
    assert {(r.k, r.group_id, r.ord, r.place) for r in match.passages_within(texts, ["k"], canon).collect()} == {(1, 1, 2, 1), (1, 2, 2, 9)}


def test_labels(spark):
    assert one(spark, labels.fnv1a32(F.lit(""))) == "811c9dc5" and one(spark, labels.fnv1a32(F.lit("a"))) == "e40c292c" and one(spark, labels.fnv1a32(F.lit("foobar"))) == "bf9cf968"
    assert one(spark, labels.url_key(F.lit("http://x.y/p?b=2&a=1#top"))) == "http://x.y/p?a=1&b=2"
    assert one(spark, labels.corrected_ref(F.lit("[A:1]"), F.lit("(B:2)"))) == "[B:2]"
    assert one(spark, labels.reference_text(F.lit("A"), F.lit(1), F.lit(3))) == "(A:1-3)"
    assert one(spark, labels.text_fragment(F.lit("a b-c"))) == "#:~:text=a%20b%2Dc"
    assert one(spark, labels.group_of_ref(F.lit("(A b:12)"))) == "A b"
    diff = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(c).alias("cited"), F.lit(a).alias("authentic")) for o, c, a in (("keep", "a<", "a<"), ("sub", "x", "y"), ("missing", "", "z"))])
    assert one(spark, labels.diff_html(diff)) == "a&lt; <del>x</del> <ins>y</ins> <ins>z</ins>"
    assert one(spark, labels.scrub_volatile(F.lit("said 3 minutes ago at 10:35 pm (4) 2 new hi"))) == "said at 10:35 pm (4) hi"


def test_text_nodes(spark):
    html = "<p>a<b> b</b></p><script>x</script>  <!-- c --><i>d</i>"
    got = pages.text_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("node").collect()
    assert [(r.node, r.text, r.start) for r in got] == [(0, "a", 0), (1, " b", 2), (2, "d", 5)]
    coded = spark.createDataFrame([(1, "<p>a&lt;b&gt; &amp;lt; &eacute;&#x41;</p>&nbsp;<i>&#66;</i>")], "page_id int, html string")
    assert [r.text for r in pages.text_nodes(coded).orderBy("node").collect()] == ["a<b> &lt; éA", "B"]
    spans = spark.createDataFrame([(1, 0, 4), (1, 5, 6)], "page_id int, start int, end int")
    nodes = pages.text_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert sorted((r.start, r.node, r["from"], r.to) for r in pages.spans_in_nodes(spans, nodes).collect()) == [(0, 0, 0, 1), (0, 1, 0, 2), (5, 2, 0, 1)]


def test_neighbours_and_nearest(spark):
    rows = [(1, 1, [5]), (1, 2, [4, 5]), (1, 3, [7, 8]), (1, 4, [8]), (1, 5, [1, 2])]
    got = findings.resolved_by_neighbours(spark.createDataFrame(rows, "page_id int, seq int, groups array<int>")).orderBy("seq").collect()
    assert [r.resolved_group for r in got] == [5, 5, 8, 8, None]
    pick = lambda refs, o: one(spark, findings.nearest_in_claimed_group(F.expr("array(" + ",".join(f"named_struct('group_id',{g},'ord',{k})" for g, k in refs) + ")"), F.lit(1), F.lit(o)))
    assert pick([(2, 9)], 1) == (2, 9) and pick([(1, 3), (1, 9)], 4) == (1, 3) and pick([(1, 3), (1, 5)], 4) is None and pick([(2, 1), (2, 2)], 1) is None


def test_suggestions(spark, canon):
    asked = spark.createDataFrame([(1, "lambda mu n"), (2, "alpha zzz gamma delta epsilon zeta eta theta"), (3, "one"), (4, "mu")], "cand_id int, text string")
    got = {(r.cand_id, r.rank): (r.group_id, r.ord, r.tier, r.coverage) for r in suggest.suggestions(asked, canon, LATIN).collect()}
    assert got == {(1, 0): (1, 2, 0, 0.375), (2, 0): (1, 1, 2, 0.8)}


def test_corrections(spark):
    columns = "url_key string, composite_key string, kind string, at timestamp, payload string"
    stamp = lambda d: __import__("datetime").datetime(2024, 1, d)
    old = spark.createDataFrame([("u", "a", None, stamp(1), "1"), ("u", "b", "text-replace", stamp(20), "2")], columns)
    new = spark.createDataFrame([("u", "b", "text-replace", stamp(21), "3"), ("u", "b", "text-replace", stamp(22), "4"), ("u", "c", "ref-edit", stamp(22), "5")], columns)
    now = F.expr("timestamp '2024-02-05'")
    kept = corrections.upserted(old, new, now)
    assert {(r.composite_key, r.payload) for r in kept.collect()} == {("b", "4"), ("c", "5")}
    found = spark.createDataFrame([("u", "x", "b"), ("u", "c", None), ("u", "d", None)], "url_key string, id string, prior_id string")
    assert {(r.id, r.correction, r.payload) for r in corrections.reapplied(found, kept, now).collect()} == {("x", "text-replace", "4"), ("c", "ref-edit", "5"), ("d", None, None)}
    assert corrections.removed(kept, kept.limit(0)).count() == 2
