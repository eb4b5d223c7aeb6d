"""Queries on quotations in other spelling, with SQL that aligns and measures word by word.

The canon is the letters of benchmark; vowels are the letters that spelling may drop, add or change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.profiles import LATIN, Profile
from quotelens.operators import align, match, suggest, verify
from quotelens.operators.canon_index import CanonIndex, kept_index
from quotelens.plans.queries import QUERIES, query
from quotelens.sources import corpus

VOWELS = Profile("vowels", LATIN.form, "aeiou")


def _passages(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("text"))
    return corpus.benchmark_passages(rows, VOWELS)


def _canon(spark, sf_dir) -> CanonIndex:
    return kept_index(_passages(spark, sf_dir), VOWELS)


_P = (
    "p AS (SELECT *, string_split(t1, ' ') AS w FROM (SELECT item_id, CAST(floor(item_id / 10.0) AS INTEGER) AS group_id, CAST(item_id % 10 + 1 AS INTEGER) AS ord, "
    "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS t1 FROM benchmark) WHERE t1 <> '')"
)
_BONES = "regexp_replace({}, '[aeiou]', '', 'g')"


def _soft(a: str, b: str) -> str:
    """Words that differ in spelling only."""
    return f"({a} = {b} OR ({_BONES.format(a)} = {_BONES.format(b)} AND abs(length({a}) - length({b})) <= 2 AND levenshtein({a}, {b}) <= greatest(1, abs(length({a}) - length({b})))))"


def _alike(a: str, b: str) -> str:
    return f"({a} = {b} OR ({_BONES.format(a)} = {_BONES.format(b)} AND levenshtein({a}, {b}) <= 1))"


def _end(x: str) -> str:
    """Whether a passage's words w have one like one to three words at an end of x."""
    forms = [f"array_to_string({x}[{i}], '')" for i in ("1:1", "1:2", "1:3")], [f"array_to_string({x}[{i}], '')" for i in ("-1:", "-2:", "-3:")]
    return " AND ".join("len(list_filter(w, lambda v: " + " OR ".join(_alike("v", f) for f in side) + ")) > 0" for side in forms)


#: asked(cand_id, x): soft_runs holds the passages that write x with words merged, split and in other spelling.
_RUNS = (
    "go AS (SELECT cand_id, group_id, ord, x, w, unnest(range(1, len(w) + 1)) AS h, 1 AS n FROM asked, p "
    "UNION SELECT cand_id, group_id, ord, x, w, h + dh, n + dn FROM go JOIN (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (3, 1)) AS s(dh, dn) "
    f"ON h + dh <= len(w) + 1 AND n + dn <= len(x) + 1 AND {_soft("array_to_string(w[h : h + dh - 1], '')", "array_to_string(x[n : n + dn - 1], '')")}), "
    f"soft_runs AS (SELECT DISTINCT cand_id, group_id, ord FROM go WHERE n = len(x) + 1 AND len(x) > 1 AND {_end('x')})"
)


def _distances(pairs: str) -> str:
    """The smallest word distance of a to a run of b, for pairs(k, a, b): apart(k, distance)."""
    base = f"CASE WHEN q = 1 THEN i + 1 ELSE least(cells[q] + 1, cells[q - 1] + CASE WHEN {_soft('a[i + 1]', 'b[q - 1]')} THEN 0 ELSE 1 END) END"
    return (
        f"dp AS (SELECT k, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda j: CAST(0 AS BIGINT)) AS cells FROM {pairs} "
        f"UNION ALL SELECT k, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda q: CAST({base} + j - q AS BIGINT)))) FROM dp WHERE i < len(a)), "
        "apart AS (SELECT k, list_min(cells) AS distance FROM dp WHERE i = len(a))"
    )


_LOOSE = "greatest(2, CAST(ceil(len({0}) / 4.0) AS INTEGER))"


def _unvowelled(word: Column) -> Column:
    """A word without its first vowel."""
    return F.regexp_replace(word, "^([^aeiou]*)[aeiou]", "$1")


_UNVOWELLED = "regexp_replace({}, '^([^aeiou]*)[aeiou]', '\\1')"


def _spelled(spark, sf_dir) -> DataFrame:
    """Eight words of each passage of ten or more, of which the first or the last is drifted, merged with its neighbour, or split, or two are merged inside."""
    w = lambda i: F.col("t1_words")[i]
    middle = lambda a, b: F.array_join(F.slice("t1_words", a + 1, b - a), " ")
    half = F.floor(F.length(w(9)) / 2).cast("int")
    kinds = [
        F.concat_ws(" ", _unvowelled(w(2)), middle(3, 10)),
        F.concat_ws(" ", middle(2, 9), _unvowelled(w(9))),
        F.concat_ws(" ", F.concat(w(2), w(3)), middle(4, 10)),
        F.concat_ws(" ", middle(2, 8), F.concat(w(8), w(9))),
        F.concat_ws(" ", middle(2, 9), F.substring(w(9), F.lit(1), half), F.substring(w(9), half + 1, F.lit(99))),
        F.concat_ws(" ", middle(2, 5), F.concat(_unvowelled(w(5)), w(6)), middle(7, 10)),
    ]
    text = F.element_at(F.array(*kinds), (F.col("item_id") % len(kinds) + 1).cast("int"))
    return _passages(spark, sf_dir).where("size(t1_words) >= 10").select(F.col("item_id").alias("cand_id"), text.alias("text"))


_SPELLED = (
    "spelled AS (SELECT item_id AS cand_id, CASE item_id % 6 "
    f"WHEN 0 THEN {_UNVOWELLED.format('w[3]')} || ' ' || array_to_string(w[4:10], ' ') WHEN 1 THEN array_to_string(w[3:9], ' ') || ' ' || {_UNVOWELLED.format('w[10]')} "
    "WHEN 2 THEN w[3] || array_to_string(w[4:10], ' ') WHEN 3 THEN array_to_string(w[3:9], ' ') || w[10] "
    "WHEN 4 THEN array_to_string(w[3:9], ' ') || ' ' || w[10][: length(w[10]) // 2] || ' ' || w[10][length(w[10]) // 2 + 1 :] "
    f"ELSE array_to_string(w[3:5], ' ') || ' ' || {_UNVOWELLED.format('w[6]')} || w[7] || ' ' || array_to_string(w[8:10], ' ') END AS text FROM p WHERE len(w) >= 10), "
    "asked AS (SELECT cand_id, list_filter(string_split(text, ' '), lambda v: v <> '') AS x FROM spelled)"
)


@query(f"WITH RECURSIVE {_P}, {_SPELLED}, {_RUNS} SELECT * FROM soft_runs")
def soft_excerpts(spark, sf_dir):
    c = match.with_words(_spelled(spark, sf_dir), VOWELS)
    met = match.softly_anchored(c, _canon(spark, sf_dir), VOWELS, whole=True)
    return met.where(align.soft_span(VOWELS.drift)("canon", "cited_words")["start"].isNotNull()).select("cand_id", "group_id", "ord")


@query(
    f"WITH RECURSIVE {_P}, asked AS (SELECT item_id AS cand_id, list_transform(w[2:9], lambda v, i: CASE WHEN i % 4 = item_id % 4 THEN 'zzz' ELSE v END) AS x FROM p WHERE len(w) >= 9), "
    f"pairs AS (SELECT [cand_id, group_id, ord] AS k, x AS a, w AS b FROM asked, p WHERE {_end('x')}), {_distances('pairs')} "
    f"SELECT CAST(k[1] AS BIGINT) AS cand_id, CAST(k[2] AS INTEGER) AS group_id, CAST(k[3] AS INTEGER) AS ord, CAST(distance AS INTEGER) AS distance FROM apart WHERE distance BETWEEN 1 AND 2"
)
def near_passages(spark, sf_dir):
    """Passages near eight words of which two are wrong, an end among them at times: all of them, with their distance."""
    text = F.array_join(F.transform(F.slice("t1_words", 2, 8), lambda w, i: F.when((i + 1) % 4 == F.col("item_id") % 4, F.lit("zzz")).otherwise(w)), " ")
    c = match.with_words(_passages(spark, sf_dir).where("size(t1_words) >= 9").select(F.col("item_id").alias("cand_id"), text.alias("text")), VOWELS)
    few = match.allowed_edits(F.size("cited_words"), True)
    met = match.softly_anchored(c, _canon(spark, sf_dir), VOWELS, edits=few).withColumn("distance", align.window_distance(VOWELS.drift)("cited_words", "canon", few))
    return met.where("distance > 0").select("cand_id", "group_id", "ord", "distance")


_TYPED = (
    "typed AS (SELECT item_id AS cand_id, CASE item_id % 4 WHEN 0 THEN array_to_string(w[1:2], ' ') || ' ' || w[3][:2] "
    f"WHEN 1 THEN w[1] || w[2] || ' ' || w[3] || ' ' || {_UNVOWELLED.format('w[4]')} WHEN 2 THEN array_to_string(w[1:2], ' ') || ' zzz ' || array_to_string(w[4:5], ' ') ELSE array_to_string(w[2:4], ' ') || ' qqqq' END AS text FROM p WHERE len(w) >= 5)"
)


def _tier_sql(n: str, asked: str) -> str:
    """found{n}(cand_id, group_id, ord, tier, words): all that the texts of asked find."""
    runs = _RUNS.replace("FROM asked", f"FROM {asked}").replace("go AS", f"go{n} AS").replace("FROM go ", f"FROM go{n} ").replace("soft_runs", f"soft_runs{n}")
    apart = _distances(f"pairs{n}").replace("dp", f"dp{n}").replace("apart AS", f"apart{n} AS")
    return (
        f"exact{n} AS (SELECT cand_id, group_id, ord FROM {asked}, p WHERE len(x) > 1 AND contains(' ' || t1, ' ' || array_to_string(x, ' '))), {runs}, "
        f"pairs{n} AS (SELECT [cand_id, group_id, ord] AS k, x AS a, w AS b FROM {asked}, p WHERE len(x) > 1 AND {_end('x')}), {apart}, "
        f"near{n} AS (SELECT CAST(k[1] AS BIGINT) AS cand_id, CAST(k[2] AS INTEGER) AS group_id, CAST(k[3] AS INTEGER) AS ord FROM apart{n} JOIN {asked} a ON a.cand_id = k[1] WHERE distance BETWEEN 1 AND {_LOOSE.format('x')}), "
        f"found{n} AS (SELECT f.cand_id, group_id, ord, min(tier) AS tier, min(len(x)) AS words FROM (SELECT *, 0 AS tier FROM exact{n} UNION ALL SELECT *, 1 FROM soft_runs{n} UNION ALL SELECT *, 2 FROM near{n}) f JOIN {asked} a USING (cand_id) GROUP BY ALL)"
    )


@query(
    f"WITH RECURSIVE {_P}, {_TYPED}, asked AS (SELECT cand_id, list_filter(string_split(text, ' '), lambda v: v <> '') AS x FROM typed), {_tier_sql('', 'asked')}, "
    f"shorter AS (SELECT cand_id, x[:-2] AS x FROM asked WHERE cand_id NOT IN (SELECT cand_id FROM found)), {_tier_sql('2', 'shorter')}, "
    "every AS (SELECT * FROM found UNION ALL SELECT * FROM found2) "
    "SELECT cand_id, CAST(row_number() OVER (PARTITION BY cand_id ORDER BY tier, group_id, ord) - 1 AS INTEGER) AS rank, group_id, ord, CAST(tier AS INTEGER) AS tier, round(least(words, len(w)) / len(w)::DOUBLE, 3) AS coverage FROM every JOIN p USING (group_id, ord)"
)
def suggest_tiers(spark, sf_dir):
    """All suggestions for texts whose last word is cut, that are spelled otherwise, that have a wrong word, and whose last word is of no passage."""
    w = lambda i: F.col("t1_words")[i]
    kinds = [
        F.concat_ws(" ", w(0), w(1), F.substring(w(2), 1, 2)),
        F.concat_ws(" ", F.concat(w(0), w(1)), w(2), _unvowelled(w(3))),
        F.concat_ws(" ", w(0), w(1), F.lit("zzz"), w(3), w(4)),
        F.concat_ws(" ", w(1), w(2), w(3), F.lit("qqqq")),
    ]
    typed = _passages(spark, sf_dir).where("size(t1_words) >= 5").select(F.col("item_id").alias("cand_id"), F.element_at(F.array(*kinds), (F.col("item_id") % 4 + 1).cast("int")).alias("text"))
    return suggest.suggestions(typed, _canon(spark, sf_dir), VOWELS, limit=0)


_PARTS = (
    "parted AS (SELECT a.item_id AS cand_id, CASE a.item_id % 3 WHEN 0 THEN a.w[-3:] WHEN 1 THEN list_concat([" + _UNVOWELLED.format("a.w[-3]") + "], a.w[-2:]) ELSE a.w[-1:] END AS first_part, b.w[1:3] AS second_part "
    "FROM p a JOIN p b ON a.group_id = b.group_id AND b.ord = a.ord + 1 WHERE len(a.w) >= 4 AND len(b.w) >= 4), "
    "asked AS (SELECT cand_id * 2 + side AS cand_id, list_filter(CASE side WHEN 0 THEN first_part ELSE second_part END, lambda v: v <> '') AS x FROM parted, (VALUES (0), (1)) AS s(side))"
)


@query(
    f"WITH RECURSIVE {_P}, {_PARTS}, {_RUNS}, whole AS (SELECT cand_id, group_id, ord FROM asked JOIN p ON len(x) > 1 AND w = x), "
    "strict AS (SELECT cand_id, group_id, ord FROM asked JOIN p ON len(x) > 1 AND contains(' ' || t1 || ' ', ' ' || array_to_string(x, ' ') || ' ') WHERE cand_id NOT IN (SELECT cand_id FROM whole)), "
    f"hits AS (SELECT * FROM whole UNION SELECT * FROM strict UNION SELECT * FROM soft_runs WHERE cand_id NOT IN (SELECT cand_id FROM whole UNION SELECT cand_id FROM strict) UNION SELECT cand_id, group_id, ord FROM asked JOIN p ON len(x) = 1 AND len(list_filter(w, lambda v: {_alike('v', 'x[1]')})) > 0), "
    "chains AS (SELECT a.cand_id // 2 AS cand_id, a.group_id, a.ord AS o, min(b.ord) AS q FROM hits a JOIN hits b ON a.cand_id % 2 = 0 AND b.cand_id = a.cand_id + 1 AND a.group_id = b.group_id AND b.ord > a.ord GROUP BY ALL), "
    "pairs AS (SELECT [c.cand_id, c.group_id, o, q] AS k, list_concat(x.x, y.x) AS a, list_concat(m.w, n.w) AS b FROM chains c JOIN asked x ON x.cand_id = 2 * c.cand_id JOIN asked y ON y.cand_id = 2 * c.cand_id + 1 JOIN p m ON m.group_id = c.group_id AND m.ord = o JOIN p n ON n.group_id = c.group_id AND n.ord = q), "
    f"{_distances('pairs')}, scored AS (SELECT k, CASE WHEN distance <= {_LOOSE.format('a')} THEN distance ELSE 1000000 END AS distance FROM apart JOIN pairs USING (k)) "
    "SELECT CAST(k[1] AS BIGINT) AS cand_id, CAST(k[2] AS INTEGER) AS group_id, k[3] || '-' || k[4] AS ords FROM (SELECT *, row_number() OVER (PARTITION BY k[1] ORDER BY distance, k[4] - k[3], k[2], k[3]) AS n FROM scored WHERE k[4] - k[3] <= 30) WHERE n = 1"
)
def segments(spark, sf_dir):
    """Quotations of the end of a passage and the beginning of the next one: word for word, in other spelling, and with one word of the first."""
    p = _passages(spark, sf_dir)
    a = p.where("size(t1_words) >= 4").select("item_id", "group_id", "ord", F.slice("t1_words", -3, 3).alias("x"))
    b = p.where("size(t1_words) >= 4").select("group_id", (F.col("ord") - 1).alias("ord"), F.array_join(F.slice("t1_words", 1, 3), " ").alias("y"))
    kinds = [F.array_join("x", " "), F.concat_ws(" ", _unvowelled(F.col("x")[0]), F.col("x")[1], F.col("x")[2]), F.col("x")[2]]
    text = F.concat(F.element_at(F.array(*kinds), (F.col("item_id") % 3 + 1).cast("int")), F.lit(" * "), F.col("y"))
    asked = a.join(b, ["group_id", "ord"]).select(F.col("item_id").alias("cand_id"), text.alias("text"))
    return verify.segment_matches(asked, _canon(spark, sf_dir), VOWELS).withColumn("ords", F.array_join("ords", "-"))


_EDITS = "list_filter(list_transform(w, lambda v, i: CASE (i * 7 + item_id) % 11 WHEN 0 THEN 'zzz' WHEN 1 THEN '' WHEN 2 THEN v || ' yyy' WHEN 3 THEN " + _UNVOWELLED.format("v") + " ELSE v END), lambda v: v <> '')"


@query(
    f"WITH RECURSIVE {_P}, pairs AS (SELECT item_id AS k, string_split(array_to_string({_EDITS}, ' '), ' ') AS a, w AS b FROM p), {_distances('pairs')} SELECT k AS item_id, CAST(distance AS INTEGER) AS distance FROM apart"
)
def edited_distance(spark, sf_dir):
    """The distance of each passage with words replaced, left out, added and in other spelling, by the place of each word."""
    edit = lambda v, i: F.when(((i + 1) * 7 + F.col("item_id")) % 11 == 0, F.lit("zzz")).when(((i + 1) * 7 + F.col("item_id")) % 11 == 1, F.lit("")).when(((i + 1) * 7 + F.col("item_id")) % 11 == 2, F.concat(v, F.lit(" yyy"))).when(((i + 1) * 7 + F.col("item_id")) % 11 == 3, _unvowelled(v)).otherwise(v)
    p = _passages(spark, sf_dir).where("size(t1_words) > 0").withColumn("text", F.array_join(F.filter(F.transform("t1_words", edit), lambda v: v != ""), " "))
    said = p.withColumn("words", F.split("text", " "))
    return said.select("item_id", align.window_distance(VOWELS.drift)("words", "t1_words", F.size("words")).alias("distance"))


__all__ = ["QUERIES"]
