"""Queries on what is shown of findings, and on what users change: identifiers, labels, insertions, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.functions import labels
from quotelens.functions.profiles import ARABIC, LATIN, script_share, split_vocative
from quotelens.operators import corrections, writer
from quotelens.plans import scan
from quotelens.plans.queries import _P, _passages, _table, query
from quotelens.plans.web import _SCRUB, _SQUEEZE

_ID = r"trim(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '[[:punct:]،؛؟«»“”‘’﴾﴿…]', '', 'g'))"


def _fnv(text: str) -> str:
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"lower(lpad(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}), lambda h, c: (xor(h, c) * 16777619) % 4294967296), 16), 8, '0'))"


_KEYED = f"k AS (SELECT conv_id, turn, {_ID.format('text')} AS form, {_ID.format('text')} || '|' || coalesce(role, '') || '|' || '|' || coalesce('b:' || turn, '') AS key FROM conversations WHERE text IS NOT NULL)"


@query(f"WITH {_KEYED} SELECT conv_id, turn, form, {_fnv('key')} || '-' || lower(to_base(length(key), 36)) AS id FROM k")
def finding_ids(spark, sf_dir):
    """Messages as findings: the form of a text that counts for its identity, and its identifier."""
    c = _table(spark, sf_dir, "conversations").where("text is not null")
    path = F.concat(F.lit("b:"), "turn")
    return c.select("conv_id", "turn", labels.normal_for_id(F.col("text")).alias("form"), labels.finding_id(F.col("text"), F.col("role"), F.lit(None).cast("string"), path).alias("id"))


_SAID = "'said ' || turn || ' minutes ago  JUST NOW 5 unread typing...'"
_WORDY = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(
    "WITH t AS (SELECT conv_id, turn, role, text, 'zz' || role AS name FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL) SELECT conv_id, turn, "
    f"'in ' || {_WORDY} AS brace, "
    f"{_SQUEEZE.format(_SCRUB.format(_SAID))} AS scrubbed, "
    "name || ':' || turn AS bare, name AS group_name, "
    "CASE turn % 3 WHEN 0 THEN '(' || name || ':' || (turn + 1) || ')' WHEN 1 THEN '[' || name || ':' || (turn + 1) || ']' ELSE name || ':' || (turn + 1) END AS corrected, "
    "'https://x/' || conv_id || '/' || turn || CASE WHEN turn % 2 = 0 THEN '-' || (turn + 2) ELSE '' END AS link, '(' || name || ':' || turn || CASE WHEN turn % 2 = 0 THEN '-' || (turn + 2) ELSE '' END || ')' AS reference, "
    f"'#:~:text=' || url_encode({_WORDY}[1:300]) AS fragment, "
    "CASE turn % 5 WHEN 0 THEN 'Verified: ' || name || ':' || turn WHEN 1 THEN 'Verified without a reference: ' || name || ':9' WHEN 2 THEN 'Wording differs from ' || name || ':9' WHEN 3 THEN 'Cited as ' || name || ':' || turn || ', found at ' || name || ':9' ELSE 'Not found in the canon' END AS tooltip FROM t"
)
def shown_labels(spark, sf_dir):
    """Labels of messages as findings: texts of braces, references in all their forms, links and tooltips."""
    turn, name = F.col("turn"), F.concat(F.lit("zz"), "role")
    t = _table(spark, sf_dir, "conversations").where("text is not null and role is not null and turn is not null")
    numbered = lambda n: F.concat(name, F.lit(":"), n.cast("string"))
    old = F.when(turn % 3 == 0, F.concat(F.lit("( "), numbered(turn), F.lit(")"))).when(turn % 3 == 1, F.concat(F.lit("["), numbered(turn), F.lit("]"))).otherwise(numbered(turn))
    last = F.when(turn % 2 == 0, turn + 2).otherwise(turn)
    verdict = F.element_at(F.array(*map(F.lit, ("green", "lightBlue", "yellow", "orange", "red"))), (turn % 5 + 1).cast("int"))
    return t.select(
        "conv_id", "turn", labels.content_of_brace(F.concat(F.lit(" in\0 "), "text", F.lit(" \0"))).alias("brace"),
        labels.scrub_volatile(F.concat(F.lit("said "), turn.cast("string"), F.lit(" minutes ago  JUST NOW 5 unread typing..."))).alias("scrubbed"),
        labels.bare_ref(labels.strip_invisible(F.concat(F.lit(chr(0x200F) + "« "), numbered(turn), F.lit(" »" + chr(0x200B))))).alias("bare"), labels.group_of_ref(old).alias("group_name"),
        labels.corrected_ref(old, F.concat(F.lit("("), numbered(turn + 1), F.lit(")"))).alias("corrected"), labels.ref_link("https://x/", F.col("conv_id"), turn, last).alias("link"),
        labels.reference_text(name, turn, last).alias("reference"), labels.text_fragment(F.col("text")).alias("fragment"), labels.tooltip(verdict, F.concat(F.lit("("), name, F.lit(":9)")), old).alias("tooltip"),
    )


@query(
    f"WITH {_P}, d AS (SELECT item_id, list_transform(w, lambda v, i: CASE i % 4 WHEN 0 THEN '<del>' || v || '</del> <ins>' || v || '&lt;&amp;</ins>' WHEN 1 THEN v WHEN 2 THEN '<del>' || v || '</del>' ELSE '<ins>&quot;' || v || '</ins>' END) AS parts FROM p) "
    "SELECT item_id, array_to_string(parts, ' ') AS html FROM d"
)
def diff_as_html(spark, sf_dir):
    """Words of passages as edits of all kinds."""
    op = lambda i: F.element_at(F.array(*map(F.lit, ("keep", "extra", "missing", "sub"))), (i % 4 + 1).cast("int"))
    part = lambda w, i: F.struct(op(i).alias("op"), F.when(i % 4 != 2, w).alias("cited"), F.when(i % 4 == 3, F.concat(w, F.lit("<&"))).when(i % 4 == 2, F.concat(F.lit('"'), w)).otherwise(w).alias("authentic"))
    return _passages(spark, sf_dir).select("item_id", labels.diff_html(F.transform("t1_words", part)).alias("html"))




@query(
    "SELECT item_id, round(CAST(CASE item_id % 4 WHEN 0 THEN 4 ELSE 0 END AS DOUBLE) / (length(lower(text)) + CASE item_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END), 9) AS share, item_id % 4 <> 2 AS has_content, "
    "CASE item_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'tashkeelOnly' ELSE 'spellingDrift' END AS deviation, CASE WHEN item_id % 2 = 0 THEN 'يَا بني' ELSE 'بني' END AS vocative, 'كلام طيب' AS cited FROM benchmark WHERE text IS NOT NULL AND length(text) < 1900"
)
def script_flags(spark, sf_dir):
    """What is said of a text's script and writing: the share of Arabic letters, marks without a letter, and how a quotation deviates."""
    k = F.col("item_id")
    letters = F.when(k % 4 == 0, F.lit("كلمة")).when(k % 4 == 1, F.lit("ab")).otherwise(F.lit(""))
    marks = chr(0x64E) + chr(0x651)
    token = F.when(k % 4 == 2, F.lit(marks)).otherwise(F.lit("ك" + marks))
    cited = F.when(k % 3 == 0, F.lit("رحمة")).when(k % 3 == 1, F.lit("رَحمة")).otherwise(F.lit("رحمه"))
    vocative = F.concat(F.when(k % 2 == 0, F.lit("ي" + chr(0x64E) + chr(0x670))).otherwise(F.lit("")), F.lit("بني"))
    rows = _table(spark, sf_dir, "benchmark").where("text is not null and length(text) < 1900")
    return rows.select("item_id", F.round(script_share(F.concat(letters, F.lower("text"))), 9).alias("share"), ARABIC.has_content(token).alias("has_content"), ARABIC.deviation(cited, F.lit("رحمة")).alias("deviation"), split_vocative(vocative).alias("vocative"), ARABIC.cited(F.lit("كلامـ*طيب")).alias("cited"))


_CHOSEN = (
    "n AS (SELECT a.item_id, a.group_id, a.ord, 'g' || a.group_id AS name, a.text, string_split(a.text, ' ') AS shown, a.w, b.text AS next FROM p a LEFT JOIN p b ON a.group_id = b.group_id AND b.ord = a.ord + 1 WHERE len(a.w) >= 6 AND len(a.w) = len(string_split(a.text, ' ')))"
)


@query(
    f"WITH {_P}, {_CHOSEN}, s AS (SELECT item_id, 'whole' AS scope, ord AS last, text AS body, name, ord FROM n UNION ALL SELECT item_id, 'typedPortion', ord, array_to_string(shown[2:4], ' '), name, ord FROM n "
    "UNION ALL SELECT item_id, 'startToEndWord', ord, array_to_string(shown[1 : list_position(w, w[5])], ' '), name, ord FROM n "
    "UNION ALL SELECT item_id, 'multiAyahs', CASE WHEN next IS NOT NULL THEN ord + 1 ELSE ord END, text || CASE WHEN next IS NOT NULL THEN ' ' || next ELSE '' END, name, ord FROM n) "
    "SELECT item_id, scope, CAST(last AS INTEGER) AS last, body, CASE item_id % 2 WHEN 0 THEN '{' || body || '}' ELSE '«' || body || '»' END || ' (' || name || ':' || ord || CASE WHEN last > ord THEN '-' || last ELSE '' END || ')' AS inserted FROM s"
)
def insertions(spark, sf_dir):
    """What an accepted suggestion puts in: all of a passage, the typed part, up to a word, and the next passage too."""
    p = _passages(spark, sf_dir)
    chosen = p.where("size(t1_words) >= 6 and size(t1_words) = size(split(text, ' '))").select(
        F.col("item_id").alias("cand_id"), "group_id", "ord", F.array_join(F.slice("t1_words", 2, 3), " ").alias("typed"), F.lit(3).alias("typed_words"), F.col("t1_words")[4].alias("end_phrase"), (F.col("ord") + 1).alias("to_ord"),
        F.when(F.col("item_id") % 2 == 1, "«").alias("open"), F.when(F.col("item_id") % 2 == 1, "»").alias("close"),
    )
    made = [writer.insertions(chosen, p, LATIN, s).select(F.col("cand_id").alias("item_id"), F.lit(s).alias("scope"), F.col("last").cast("int").alias("last"), "body", "inserted") for s in ("whole", "typedPortion", "startToEndWord", "multiAyahs")]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@query(
    "WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL), b AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '{' WHEN 1 THEN '“' ELSE '«' END AS o, CASE turn % 3 WHEN 0 THEN '}' WHEN 1 THEN '”' ELSE '»' END AS z FROM c) "
    "SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS cited, CASE WHEN turn % 4 <> 3 THEN o END AS open, CASE WHEN turn % 4 <> 3 THEN z END AS close FROM b"
)
def begun_quotations(spark, sf_dir):
    """Messages behind an opening mark, of which every fourth is closed."""
    t = F.col("turn")
    pick = lambda marks: F.element_at(F.array(*map(F.lit, marks)), (t % 3 + 1).cast("int"))
    before = F.concat(F.lit("x {y} "), pick("{“«"), "text", F.when(t % 4 == 3, pick("}”»")).otherwise(F.lit("")))
    rows = _table(spark, sf_dir, "conversations").where("text is not null and turn is not null and conv_id is not null")
    found = rows.select("conv_id", "turn", writer.begun_quotation(before).alias("q"))
    return found.select("conv_id", "turn", "q.cited", "q.open", "q.close")


def _judged(spark, sf_dir) -> DataFrame:
    """Passages as findings of all colours, with the corrections that some have."""
    p = _passages(spark, sf_dir)
    k = F.col("item_id")
    verdict = F.element_at(F.array(*map(F.lit, ("green", "orange", "yellow", "lightBlue", "red"))), (k % 5 + 1).cast("int"))
    other = F.when(F.col("ord") > 1, F.col("ord") - 1).otherwise(F.col("ord") + 1)
    claimed = F.when(verdict == "orange", other).otherwise(F.col("ord"))
    refs = F.when(verdict == "red", F.array().cast("array<struct<group_id:int,ord:int>>")).otherwise(F.array(F.struct("group_id", "ord")))
    return p.select(
        F.lit(1).alias("page_id"), F.lit("u").alias("url_key"), F.concat(F.lit("f"), k).alias("id"), F.lit(None).cast("string").alias("prior_id"), verdict.alias("verdict"), F.col("t1").alias("text"), F.lit(0).alias("start"), k.cast("int").alias("end"),
        F.concat(F.lit("["), "group_name", F.lit(":"), claimed.cast("string"), F.lit("]")).alias("ref"), F.col("group_id").alias("claimed_group"), F.array(claimed.cast("int")).alias("ords"), refs.alias("refs"),
    )


_JUDGED = (
    "j AS (SELECT item_id, group_id, ord, text, t1, ['green', 'orange', 'yellow', 'lightBlue', 'red'][item_id % 5 + 1] AS verdict, '[g' || group_id || ':' || CASE WHEN item_id % 5 = 1 THEN CASE WHEN ord > 1 THEN ord - 1 ELSE ord + 1 END ELSE ord END || ']' AS ref, '[g' || group_id || ':' || ord || ']' AS own FROM p), "
    "a AS (SELECT *, CASE WHEN item_id % 15 = 2 THEN 'text-replace' WHEN item_id % 15 = 3 THEN 'reference-attribution' WHEN verdict = 'orange' THEN 'ref-edit' END AS correction FROM j)"
)
_NEW = "new AS (SELECT *, CASE WHEN correction IN ('ref-edit', 'reference-attribution') AND verdict <> 'red' THEN own END AS new_ref, CASE WHEN correction = 'text-replace' AND verdict <> 'red' THEN text END AS new_text FROM a)"


def _fixed(spark, sf_dir) -> DataFrame:
    kept = _table(spark, sf_dir, "benchmark").where("item_id % 15 in (2, 3)").select(F.lit("u").alias("url_key"), F.concat(F.lit("f"), "item_id").alias("composite_key"), F.when(F.col("item_id") % 15 == 2, "text-replace").otherwise("reference-attribution").alias("kind"), F.expr("timestamp '2024-01-01'").alias("at"), F.lit(None).cast("string").alias("payload"))
    return scan.corrected(_judged(spark, sf_dir), kept, F.expr("timestamp '2024-01-05'"), _passages(spark, sf_dir), ("orange",))


_SUCCESSOR = _ID.format("t1") + " || '|' || new_ref || '|g' || group_id || ':' || ord || '|0:' || item_id"


@query(
    f"WITH {_P}, {_JUDGED}, {_NEW}, s AS (SELECT *, CASE WHEN correction = 'ref-edit' AND new_ref IS NOT NULL THEN {_SUCCESSOR} END AS key FROM new) "
    f"SELECT 'f' || item_id AS was, CASE WHEN key IS NOT NULL THEN {_fnv('key')} || '-' || lower(to_base(length(key), 36)) ELSE 'f' || item_id END AS id, correction, new_ref, new_text, "
    "CASE WHEN (new_ref IS NOT NULL OR new_text IS NOT NULL) AND correction <> 'reference-attribution' THEN 'lightGreen' ELSE verdict END AS display FROM s"
)
def corrected_findings(spark, sf_dir):
    """Findings after kept corrections of text and reference, and those of orange ones made without asking."""
    fixed = _fixed(spark, sf_dir)
    return fixed.select(F.coalesce("prior_id", "id").alias("was"), "id", "correction", "new_ref", "new_text", "display")


@query(f"WITH {_P}, {_JUDGED} SELECT 'f' || item_id AS id, verdict, ref FROM j")
def reverted_findings(spark, sf_dir):
    """All corrections taken back: the findings as they were."""
    found, fixed = _judged(spark, sf_dir), _fixed(spark, sf_dir)
    back = corrections.reverted(fixed.select(found.columns), found, fixed.where("correction is not null").select("page_id", "id"), ["page_id"])
    return back.select("id", "verdict", "ref")


@query(
    "WITH e AS (SELECT DISTINCT user_id % 7 AS u, event_id % 11 AS c, CASE WHEN event_id % 2 = 0 THEN 'ref-edit' ELSE 'dismissal' END AS kind FROM events) SELECT CAST(u AS VARCHAR) AS url_key, CAST(c AS VARCHAR) AS composite_key, kind FROM e WHERE NOT (kind = 'dismissal' AND c < 5)"
)
def restored(spark, sf_dir):
    """Dismissals that are taken back are gone from what is kept."""
    kept = _table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("url_key"), (F.col("event_id") % 11).cast("string").alias("composite_key"), F.when(F.col("event_id") % 2 == 0, "ref-edit").otherwise("dismissal").alias("kind")).distinct()
    return corrections.removed(kept, kept.where("kind = 'dismissal' and cast(composite_key as int) < 5"))


