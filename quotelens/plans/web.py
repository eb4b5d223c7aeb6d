"""Queries on pages as trees, and on where references are written in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.functions.profiles import ARABIC
from quotelens.operators import ref_marks as marks
from quotelens.plans import scan
from quotelens.plans.queries import _ARABIC_SQL, _arabic_canon, query
from quotelens.sources import corpus, elements
from quotelens.sql import register

_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_SCRUB = "{}"
for _p in (
    r"(?i)\b\d+\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s*ago\b",
    r"(?i)\bjust\s*now\b",
    r"(?i)\b(?:yesterday|today)\b",
    r"(?i)\b(?:online|offline|typing\.{{0,3}}|last\s+seen\s+[^.\n]{{0,40}})\b",
    r"(?i)\b\d+\s*(?:new|unread)\b",
):
    _SCRUB = f"regexp_replace({_SCRUB}, '{_p}', ' ', 'g')"


def _threads(spark, sf_dir) -> DataFrame:
    """Each conversation as a page: a message is a name, its text in elements of its own, and things that are no text."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("length(trim(text)) >= 3 and length(role) >= 3 and turn is not null")
    coded = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    message = F.concat(F.lit("<div class='m' title=\"a > b\"><b>"), "role", F.lit("</b><svg><g>hid<b>den</b></g></svg><p><q><i>"), coded, F.lit("</i></q></p><noscript><p>none</p></noscript></div>"))
    pages = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    return pages.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("<html><head><title>no</title></head><body><div>"), F.array_join(F.transform("ms", lambda m: m["m"]), "\n"), F.lit("</div></body></html>")).alias("html"))


_SAID = (
    "said AS (SELECT conv_id, turn, role, text, CAST(2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn, '<b>' || role || text) - 2 AS INTEGER) AS node FROM conversations WHERE length(trim(text)) >= 3 AND length(role) >= 3 AND turn IS NOT NULL)"
)


@query(
    f"WITH {_SAID}, raw AS (SELECT conv_id, node, ' · ' || text AS other FROM said UNION ALL SELECT conv_id, node + 1, role || ' · ' FROM said), "
    f"squeezed AS (SELECT conv_id, node, {_SQUEEZE.format(_SCRUB.format(_SQUEEZE.format('other')))} AS c FROM raw) "
    "SELECT conv_id AS page_id, md5(CASE WHEN length(c) <= 200 THEN c ELSE c[:100] || ' … ' || c[-100:] END) AS context, count(*) AS n FROM squeezed GROUP BY ALL"
)
def context_texts(spark, sf_dir):
    """The words around each name and message of a conversation, counted."""
    nodes = elements.tree_nodes(_threads(spark, sf_dir))
    found = elements.contexts(nodes)
    return found.groupBy("page_id", F.md5(F.col("context").cast("binary")).alias("context")).agg(F.count("*").alias("n"))


@query(f"WITH {_SAID} SELECT conv_id AS page_id, 2 * count(*) AS n_nodes, CAST(sum(length(role) + length(text)) AS BIGINT) AS n_chars FROM said GROUP BY conv_id")
def tree_text_nodes(spark, sf_dir):
    """Text nodes among nested elements that hide theirs, and tags with a sign of their end in an attribute."""
    nodes = elements.tree_nodes(_threads(spark, sf_dir)).where("shown")
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "WITH c AS (SELECT conv_id, turn, text, length(text) AS n, '(' || role || ':' || turn || ')' AS ref, turn % 4 AS k FROM conversations WHERE length(text) > 0 AND role IS NOT NULL AND turn IS NOT NULL) "
    "SELECT conv_id, turn, CASE WHEN k < 3 THEN CAST(n + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 401 - length(ref) END AS INTEGER) END AS start, "
    "CASE WHEN k < 3 THEN CAST(n + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 401 - length(ref) END + length(ref) + CASE k WHEN 1 THEN 2 ELSE 0 END AS INTEGER) END AS \"end\" FROM c"
)
def reference_marks(spark, sf_dir):
    """References written after messages: as they are, with invisible marks in them and before, far off, and too far."""
    rlm, zero = chr(0x200F), chr(0x200B)
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("length(text) > 0 and role is not null and turn is not null")
    ref = F.concat(F.lit("("), "role", F.lit(":"), "turn", F.lit(")"))
    marked = F.concat(F.lit(f"({zero}"), "role", F.lit(f":{rlm}"), "turn", F.lit(")"))
    kinds = [F.concat(F.lit(" "), ref, F.lit(" "), ref), F.concat(F.lit(f" {rlm}"), marked, F.lit(rlm)), F.concat(F.lpad(F.lit(""), F.lit(401) - F.length(ref), F.lit("-")), ref), F.concat(F.lpad(F.lit(""), F.lit(401), F.lit("-")), ref)]
    page = F.concat("text", F.element_at(F.array(*kinds), (F.col("turn") % 4 + 1).cast("int")))
    key = F.struct("conv_id", "turn", F.xxhash64("text")).alias("page_id")
    found = c.select(key, "conv_id", "turn", F.length("text").alias("end"), ref.alias("ref"))
    done = marks.ref_marks(found, c.select(key, page.alias("text")).distinct())
    return done.select("conv_id", "turn", F.col("mark.start").alias("start"), F.col("mark.end").alias("end"))


@query(
    f"WITH {_SAID}, n AS (SELECT conv_id, role AS t FROM said UNION ALL SELECT conv_id, text FROM said) SELECT conv_id AS page_id, count(*) AS n_nodes, CAST(sum(len(list_filter(string_split(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> ''))) AS BIGINT) AS n_words, "
    "min('(c:' || CAST(conv_id AS INTEGER) || CASE WHEN conv_id < 5 THEN '-5' ELSE '' END || ')') AS ref FROM n GROUP BY conv_id"
)
def words_by_sql(spark, sf_dir):
    """Words of pages, by SQL alone."""
    register(spark)
    _threads(spark, sf_dir).createOrReplaceTempView("quotelens_threads")
    return spark.sql(
        "SELECT p.page_id, count(*) AS n_nodes, sum(size(words_of(latin_form(n.text)))) AS n_words, min(reference_text('c', CAST(p.page_id AS INT), CASE WHEN p.page_id < 5 THEN 5 ELSE 0 END)) AS ref "
        "FROM quotelens_threads p, LATERAL page_nodes(p.html) n WHERE n.shown GROUP BY p.page_id"
    )


def _forms(spark, sf_dir) -> DataFrame:
    """A page for each passage and way to quote it: from one part to another, with an ellipsis, in other spelling, with two words as one, without marks before a reference, and of two passages."""
    p = _arabic_canon(spark, sf_dir).where("size(raw) >= 12")
    words = lambda first, n: F.array_join(F.slice("raw", first, n), " ")
    quoted = lambda text: F.concat(F.lit("قال تعالى: {"), text, F.lit("}"))
    ref = F.concat(F.lit(" ("), "ref", F.lit(")"))
    dropped = F.regexp_replace(words(2, 6), "[ايو]([^ ]* [^ ]*)$", "$1")
    both = F.concat(F.lit(" ("), "group_name", F.lit(":"), F.col("ord"), F.lit("-"), F.col("ord") + 1, F.lit(")"))
    following = p.select("group_id", (F.col("ord") - 1).alias("ord"), F.array_join(F.slice("raw", 1, 5), " ").alias("next"))
    p = p.join(following, ["group_id", "ord"], "left")
    kinds = [
        F.concat(F.lit("{"), words(1, 4), F.lit("} إلى قوله: {"), words(7, 5), F.lit("}"), ref),
        F.concat(quoted(F.concat(words(1, 3), F.lit(" ... "), words(6, 4))), ref),
        F.concat(quoted(dropped), ref),
        F.concat(quoted(F.concat(F.col("raw")[1], words(3, 5))), ref),
        F.concat(F.lit("1 "), words(3, 6), ref),
        F.when(F.col("next").isNotNull(), F.concat(quoted(F.concat(F.array_join(F.slice("raw", -5, 5), " "), F.lit(" "), "next")), both)),
    ]
    pages = p.select("item_id", F.posexplode(F.array(*kinds)).alias("kind", "said")).where("said is not null")
    return pages.select((F.col("item_id") * 10 + F.col("kind")).alias("page_id"), F.concat(F.lit("<p>"), "said", F.lit("</p>")).alias("html"))


@query(
    f"WITH {_ARABIC_SQL}, f AS (SELECT c.item_id, c.name || ':' || c.ord AS ref, c.raw, length(regexp_extract(c.raw[6], '^[^ايو]*')) AS before, n.item_id IS NOT NULL AS has_next FROM canon c LEFT JOIN canon n ON n.group_id = c.group_id AND n.ord = c.ord + 1 AND len(n.raw) >= 12 WHERE len(c.raw) >= 12), "
    "k AS (SELECT * FROM (VALUES (0, 0, 'rangeConstruct'), (0, 1, 'rangeConstruct'), (1, 0, 'leadInBraced'), (2, 0, 'leadInBraced'), (3, 0, 'leadInBraced'), (4, 0, 'explicitRefBackward'), (5, 0, 'leadInBraced')) AS k(kind, seq, strategy)) "
    "SELECT item_id * 10 + kind AS page_id, CAST(seq AS INTEGER) AS seq, strategy, CASE WHEN kind = 2 AND before > 0 AND raw[6][before] = raw[6][before + 2] OR kind = 3 AND raw[2][-1] = raw[3][1] AND raw[3][1] NOT IN ('ا', 'ي', 'و') THEN 'yellow' ELSE 'green' END AS verdict, ref AS matched FROM f, k WHERE kind < 5 OR has_next"
)
def scan_forms(spark, sf_dir):
    """Pages that quote rightly in all ways but the plain one: everything is green, with its first passage; but where letters that meet make a doubled one, which is written as one, the word is another."""
    canon = _arabic_canon(spark, sf_dir).drop("item_id", "raw")
    names = corpus.ref_names(spark, canon.select(F.col("group_name").alias("name"), "group_id").distinct(), ARABIC)
    found = scan.scan(_forms(spark, sf_dir), canon, names, ARABIC)
    return found.select("page_id", "seq", "strategy", "verdict", "matched")
