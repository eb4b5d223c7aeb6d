"""Pages to findings, reports and corrections; the writer's insertions."""

import pytest
from pyspark.sql import functions as F

from quotelens.functions.profiles import ARABIC, LATIN
from quotelens.operators import writer
from quotelens.plans import scan
from quotelens.sources import corpus

VERSES = [(1, 1, "الفاتحة", "الحمد لله رب العالمين الرحمن الرحيم"), (1, 2, "الفاتحة", "مالك يوم الدين إياك نعبد وإياك نستعين"), (2, 1, "البقرة", "ذلك الكتاب لا ريب فيه هدى للمتقين الذين يؤمنون بالغيب")]
HTML = """<article><p>قال تعالى: {الحمد لله رب العالمين} (الفاتحة:1)</p><p>قال تعالى: {مالك يوم الدين إياك نعبد وإياك نستعين} (البقرة:1)</p>
<p>قوله تعالى: {ذلك الكتاب لا شك فيه هدى للمتقين الذين يؤمنون بالغيب} (البقرة:1)</p><p>قال تعالى: {كلام ليس من هذا في شيء} (البقرة:1)</p><p>هنا {يوم الدين إياك نعبد}</p></article>"""


@pytest.fixture(scope="module")
def canon(spark):
    return corpus.passages_of(spark.createDataFrame(VERSES, "group_id int, ord int, group_name string, text string"), ARABIC).cache()


@pytest.fixture(scope="module")
def found(spark, canon):
    names = corpus.ref_names(spark, canon.select(F.col("group_name").alias("name"), "group_id").distinct(), ARABIC)
    pages = spark.createDataFrame([(1, "http://a/?x=1", HTML), (2, "http://b/", None)], "page_id int, url string, html string")
    return scan.scan(pages, canon, names, ARABIC).cache(), pages


def test_findings(found):
    rows = found[0].orderBy("seq").collect()
    assert [(r.verdict, r.match_type) for r in rows] == [("green", "exact"), ("orange", "exact"), ("yellow", "partial"), ("red", "none"), ("lightBlue", "orderedContiguous")]
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4] and len({r.id for r in rows}) == 5 and rows[1].matched == "الفاتحة:2"


def test_enriched(spark, canon, found):
    got = {r.verdict: r for r in scan.enriched(found[0], canon, ARABIC).collect()}
    assert got["green"].excerpt == "الحمد لله رب العالمين" and got["lightBlue"].excerpt == "يوم الدين إياك نعبد"
    assert [d.op for d in got["yellow"].diff].count("sub") == 1 and got["yellow"].excerpt == VERSES[2][3] and got["red"].near is None
    red = found[0].where("verdict = 'red'").withColumn("text", F.lit("ذلك شيء لا ريب شيء هدى للمتقين الذين يؤمنون بالغيب")).unionByName(found[0].where("verdict = 'red'").withColumn("text", F.lit("لله رب العالمين لله رب العالمين")).withColumn("start", F.lit(1)))
    near = {r.start: r.near for r in scan.enriched(red, canon, ARABIC).collect()}
    assert (near[1].group_id, near[1].first, near[1].distance) == (1, 1, 0)
    other = next(v for k, v in near.items() if k != 1)
    assert (other.group_id, other.first, other.distance, other.rivals) == (2, 1, 2, 0)


def test_report(found):
    got = {r.page_id: r for r in scan.page_report(*found).collect()}
    assert (got[1].n_total, got[1].state, got[1].severity, got[1].badge, got[1].n_fixable) == (5, "defects", 3, "!", 1)
    assert (got[2].n_total, got[2].state) == (0, "empty") and '"n_red":1' in got[1].line
    assert scan.highlights(found[0]).where("class = 'quote-orange' and marks_ref").count() == 1


def test_corrections_apply(spark, canon, found):
    keyed = found[0].withColumn("url_key", F.lit("u")).withColumn("prior_id", F.lit(None).cast("string"))
    yellow = keyed.where("verdict = 'yellow'").select("id").first().id
    kept = spark.createDataFrame([("u", yellow, "text-replace", None)], "url_key string, composite_key string, kind string, payload string").withColumn("at", F.expr("timestamp '2024-01-01'"))
    got = {r.verdict: r for r in scan.corrected(keyed, kept, F.expr("timestamp '2024-01-05'"), canon, ("orange",)).collect()}
    assert got["orange"].new_ref == "الفاتحة:2" and got["orange"].display == "lightGreen" and got["orange"].prior_id and got["orange"].id != got["orange"].prior_id
    assert got["yellow"].new_text == VERSES[2][3] and got["green"].correction is None and got["red"].display == "red"


def test_doubled_phrases(spark):
    canon = corpus.passages_of(spark.createDataFrame([(1, 1, "One", "a b c d e")], "group_id int, ord int, group_name string, text string"), LATIN)
    got = scan.doubled(spark.createDataFrame([(1, "b c b c"), (2, "b c d e"), (3, "x y x y")], "cand_id int, text string"), canon, LATIN).collect()
    assert [(r.cand_id, r.phrase, r.ord) for r in got] == [(1, "b c", 1)]


def test_begun_quotations(spark):
    texts = ["قال تعالى: {الحمد لله", "قال تعالى: الحمد لله", "done {x y} and", 'he said "to be', "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", writer.begun_quotation(F.col("t")).alias("q")).orderBy("i").collect()
    assert [tuple(r.q) if r.q else None for r in got] == [("الحمد لله", "{", "}"), ("الحمد لله", None, None), None, ("to be", '"', '"'), None, None]


def test_insertions(spark):
    rows = [(1, i + 1, "One", t) for i, t in enumerate(["Alpha beta, gamma delta", "epsilon zeta", "eta"])]
    canon = corpus.passages_of(spark.createDataFrame(rows, "group_id int, ord int, group_name string, text string"), LATIN)
    chosen = spark.createDataFrame([(1, 1, 1, 2, "Gamma", 2, "«", "»")], "cand_id int, group_id int, ord int, typed_words int, end_phrase string, to_ord int, open string, close string")
    text = lambda scope, **k: writer.insertions(chosen, canon, LATIN, scope, **k).first().inserted
    assert text("whole") == "«Alpha beta, gamma delta» (One:1)"
    assert text("typedPortion") == "«Alpha beta,» (One:1)"
    assert text("startToEndWord", before=True) == "(One:1) «Alpha beta, gamma»"
    typed = chosen.withColumn("typed", F.lit("BETA gamma and"))
    assert writer.insertions(typed, canon, LATIN, "typedPortion").first().inserted == "«beta, gamma» (One:1)"
    assert writer.insertions(chosen.withColumn("end_phrase", F.lit("beta gamma")), canon, LATIN, "startToEndWord").first().body == "Alpha beta, gamma"
    assert writer.insertions(chosen.withColumn("end_phrase", F.lit("gamma beta")), canon, LATIN, "startToEndWord").first().inserted is None
    assert text("multiAyahs", as_number=True) == "«Alpha beta, gamma delta epsilon zeta» (1:1-2)"
    assert text("surahEnd").endswith("eta» (One:1-3)")
    with pytest.raises(ValueError):
        writer.insertions(chosen, canon, LATIN, "other")


def test_corrected_references_are_verified_again(spark, canon, found):
    names = corpus.ref_names(spark, canon.select(F.col("group_name").alias("name"), "group_id").distinct(), ARABIC)
    keyed = found[0].withColumn("url_key", F.lit("u")).withColumn("prior_id", F.lit(None).cast("string"))
    kept = spark.createDataFrame([], "url_key string, composite_key string, kind string, payload string, at timestamp")
    fixed = scan.corrected(keyed, kept, F.expr("timestamp '2024-01-05'"), canon, ("orange",))
    assert {r.verdict: r.now for r in scan.reverified(fixed, canon, names, ARABIC).collect()} == {"orange": "green", "green": None, "yellow": None, "red": None, "lightBlue": None}
    changes = [("a", "(الفاتحة:2)", None), ("b", "(الفاتحة:9)", None), ("c", None, "يوم الدين إياك نعبد"), ("d", None, "كلام اخر هنا"), ("e", None, None), ("f", "(شيء:1)", "يوم الدين إياك نعبد")]
    got = scan.accepted(spark.createDataFrame(changes, "k string, ref string, text string"), canon, names, ARABIC)
    assert {r.k for r in got.collect()} == {"a", "c", "e"}
