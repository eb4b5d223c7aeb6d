"""The functions of SQL are those of columns; table functions say what they can't take."""

import pytest
from pyspark.sql import functions as F

from quotelens import sql
from quotelens.functions import labels
from quotelens.functions.profiles import LATIN, Profile
from quotelens.operators.extract import marks_of
from quotelens.sources.elements import tree_of


def test_functions_equal_columns(spark):
    sql.register(spark)
    vowels = Profile("v", LATIN.form, "aeiou")
    rows = [("Été, 2nd—Été!", "stone", "stne", 1, 3), ("  a  b ", "stone", "stane", 2, 2), ("", "stone", "stones", 1, 0), (None, "a", None, 1, 2)]
    df = spark.createDataFrame(rows, "t string, a string, b string, i int, j int")
    df.createOrReplaceTempView("given")
    got = spark.sql("SELECT latin_form(t) f, words_of(latin_form(t)) w, skeleton(a, 'aeiou') s, same_spelling(a, b, 'aeiou') e, holds_run('x a b', 'a b') h, reference_text('n', i, j) r FROM given").collect()
    form = LATIN.form(F.col("t"))
    want = df.select(form.alias("f"), LATIN.words(form).alias("w"), vowels.skeleton(F.col("a")).alias("s"), vowels.same_word(F.col("a"), F.col("b")).alias("e"), F.lit(True).alias("h"), labels.reference_text(F.lit("n"), F.col("i"), F.col("j")).alias("r")).collect()
    assert got == want


def test_table_functions(spark):
    sql.register(spark)
    page, body = "<p title='>'>a<svg>no</svg></p>b", "قال تعالى: {الحمد لله رب العالمين} (الفاتحة:2)"
    spark.createDataFrame([(1, page, body), (2, None, None)], "k int, html string, body string").createOrReplaceTempView("given")
    got = spark.sql("SELECT k, n.* FROM given, LATERAL page_nodes(html) n ORDER BY node").collect()
    assert [(r.k, r.node, r.text, r.start, r.path, r.tags, r.shown) for r in got] == [(1, i, n["text"], n["start"], n["path"], n["tags"], n["shown"]) for i, n in enumerate(tree_of(page))]
    got = spark.sql("SELECT m.* FROM given, LATERAL quotation_marks(body) m").collect()
    assert sorted((r.kind, r.start, r.end, r.inner) for r in got) == sorted((*m[:3], body[m[3] : m[4]]) for m in marks_of(body)) and {"lead", "strong", "ref"} <= {r.kind for r in got}
    with pytest.raises(Exception, match="a text is asked for"):
        spark.sql("SELECT * FROM page_nodes(1)").collect()
