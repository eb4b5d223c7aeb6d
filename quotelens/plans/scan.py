"""From pages to findings, reports and corrected findings: the lifecycle of a scan as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import labels
from quotelens.functions.profiles import Profile
from quotelens.functions.windows import canon_side
from quotelens.operators import align, canon_index, corrections, extract, findings, match, references, verify
from quotelens.sources import pages
from quotelens.store import materialize

#: The pause between two copies of a phrase within which a quotation is taken for a doubled one.
CONTEXT = 200


def scan(web_pages: DataFrame, passages: DataFrame, names: DataFrame, profile: Profile, cap: int = findings.CAP) -> DataFrame:
    """Findings of web pages (page_id, html): what they quote, with the verdict on it.

    page_id, seq, id, start, end, text, ref, strategy, claimed_group, ords, verdict, match_type, deviation, diffs, refs,
    matched, session. Findings of one identity count once, and a page has at most cap of them.
    """
    texts = pages.joined_text(web_pages)
    found = extract.candidates(texts)
    asked = references.resolved(found, names, profile).withColumn("cand_id", F.struct("page_id", "start", "end"))
    asked = materialize(asked, "asked")
    judged = verify.memoized(asked.select("cand_id", "text", "high", "claimed_group", "ords", "range_ords"), passages, profile)
    out = findings.checked(asked.join(judged, "cand_id"))
    first = F.try_element_at(F.col("refs"), F.lit(1))
    label = passages.select(F.col("group_id").alias("_g"), F.col("ord").alias("_o"), F.col("ref").alias("matched"))
    out = out.withColumn("_first", first).join(canon_side(label, passages), (F.col("_first.group_id") == F.col("_g")) & (F.col("_first.ord") == F.col("_o")), "left").drop("_g", "_o", "_first")
    around = texts.select("page_id", F.col("text").alias("_page"))
    out = out.join(around, "page_id").withColumn("_context", labels.scrub_volatile(F.translate(F.substring("_page", F.greatest(F.col("start") - CONTEXT // 2, F.lit(1)), F.lit(CONTEXT) + F.col("end") - F.col("start")), "\0", " "))).drop("_page")
    out = out.withColumn("matched", labels.in_claimed_spelling(F.col("matched"), F.col("ref"), profile.form))
    out = out.withColumn("id", labels.finding_id(F.col("text"), F.col("ref"), F.col("matched"), F.concat_ws(":", "start", "end")))
    out = findings.occurrence(out, ["page_id", "text", "ref"], "start")
    identity = [labels.normal_for_id(F.col("text")), F.coalesce("ref", F.lit("")), F.col("_context"), F.col("occurrence").cast("string")]
    # findings are one by the parts of their identity; session is its short name
    out = out.withColumn("session", labels.fnv1a32(F.concat_ws("|", *identity))).withColumn("_identity", F.array(*identity))
    out = findings.latest(out, ["page_id", "_identity"], [F.col("start")])
    out = findings.first_per_page(out, "page_id", ["start", "end"], cap)
    out = findings.occurrence(out.drop("occurrence"), ["page_id"], "start").withColumnRenamed("occurrence", "seq")
    return out.select("page_id", "seq", "id", "start", "end", "text", "ref", "strategy", "claimed_group", "ords", "verdict", "match_type", "deviation", "diffs", "refs", "matched", "session")


def enriched(found: DataFrame, passages: DataFrame, profile: Profile) -> DataFrame:
    """found (as scan() gives it) with excerpt, diff and near.

    excerpt: the passage's own words for those that are quoted, null where they don't align. diff: the edits from a yellow
    quotation to the passage matched. near: of a red one the closest passage or run of passages within reach, with its edits and
    rivals; else, if it says one phrase of a passage several times over, that passage, with distance 0.
    """
    found = materialize(found, "found")
    edits = "array<struct<op:string,cited:string,authentic:string>>"
    near_type = f"struct<group_id:int,first:int,last:int,distance:int,diff:{edits},rivals:int>"
    nothing = {"excerpt": F.lit(None).cast("string"), "diff": F.lit(None).cast(edits), "near": F.lit(None).cast(near_type)}
    own = passages.select(F.col("group_id").alias("_g"), F.col("ord").alias("_o"), F.col("t1_words").alias("_canon"), F.coalesce("display_words", "t1_words").alias("_shown"))
    matched = match.with_words(found.where("verdict <> 'red'"), profile).withColumn("_first", F.try_element_at("refs", F.lit(1)))
    matched = matched.join(canon_side(own, passages), (F.col("_first.group_id") == F.col("_g")) & (F.col("_first.ord") == F.col("_o")), "left")
    excerpt = lambda start, length: F.array_join(F.slice("_shown", start + 1, length), " ")
    exact = matched.where("verdict <> 'yellow'").withColumn("_w", align.soft_span(profile.drift)("_canon", "cited_words"))
    exact = exact.withColumn("excerpt", F.when(F.col("_w.start").isNotNull(), excerpt(F.col("_w.start"), F.col("_w.end") - F.col("_w.start"))))
    yellow = matched.where("verdict = 'yellow'").withColumn("_w", align.best_window(profile.drift)("cited_words", "_canon", "_shown"))
    yellow = yellow.withColumn("excerpt", F.when(F.col("_w.start").isNotNull(), excerpt(F.col("_w.start"), F.col("_w.length")))).withColumn("diff", F.col("_w.diff"))
    red = found.where("verdict = 'red'")
    asked = red.select(F.struct("page_id", "start", "end").alias("cand_id"), "text")
    close = verify.near_matches(asked, passages, profile).select("cand_id", F.struct("group_id", "first", "last", "distance", "diff", "rivals").alias("near"))
    twice = doubled(asked, passages, profile).groupBy("cand_id").agg(F.min(F.struct("group_id", "ord")).alias("p"))
    twice = twice.select("cand_id", F.struct("p.group_id", F.col("p.ord").alias("first"), F.col("p.ord").alias("last"), F.lit(0).alias("distance"), F.lit(None).cast(edits).alias("diff"), F.lit(0).alias("rivals")).alias("phrase"))
    red = red.withColumn("cand_id", F.struct("page_id", "start", "end")).join(close, "cand_id", "left").join(twice, "cand_id", "left").withColumn("near", F.coalesce(F.col("near").cast(near_type), F.col("phrase").cast(near_type)))
    parts = (exact, yellow, red)
    whole = [part.select(*found.columns, *[F.col(c) if c in part.columns else nothing[c].alias(c) for c in nothing]) for part in parts]
    return whole[0].unionByName(whole[1]).unionByName(whole[2])


def page_report(found: DataFrame, web_pages: DataFrame) -> DataFrame:
    """Counts, state and badge of every page, and the same as one line of JSON."""
    every = web_pages.select("page_id", "url").join(found.select("page_id", "verdict", "refs", "claimed_group", "ords"), "page_id", "left")
    fixable = (F.col("verdict") == "orange") & findings.nearest_in_claimed_group(F.col("refs"), F.col("claimed_group"), F.try_element_at("ords", F.lit(1))).isNotNull()
    counts = findings.verdict_counts(every, ["page_id", "url"]).join(every.groupBy(F.col("page_id").alias("_p")).agg(F.count_if(fixable).alias("n_fixable")), F.col("page_id").eqNullSafe(F.col("_p"))).drop("_p")
    counts = counts.withColumn("badge", findings.badge(F.col("state"), F.col("severity")))
    return counts.withColumn("line", F.to_json(F.struct("page_id", "url", *[c for c in counts.columns if c.startswith("n_")], "state")))


def highlights(found: DataFrame) -> DataFrame:
    """What to draw on a page: span, class and tooltip."""
    return found.select("page_id", "start", "end", F.concat(F.lit("quote-"), F.lower("verdict")).alias("class"), labels.tooltip(F.col("verdict"), F.col("matched"), F.col("ref")).alias("tooltip"), (F.col("ref").isNotNull() & (F.col("verdict") == "orange")).alias("marks_ref"))


def doubled(red: DataFrame, passages: DataFrame, profile: Profile) -> DataFrame:
    """Quotations that say one phrase of a passage several times over, in whatever spelling: cand_id, phrase (as it is said first) and the passages that have it once."""
    c = match.with_words(red, profile).withColumn("n", F.size("cited_words")).where("n >= 4")
    periods = F.filter(F.sequence(F.lit(2), F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(2))), lambda p: F.col("n") % p == 0)
    split = c.withColumn("p", F.explode(periods))
    # each word is, but for spelling, the one a period later
    rest = lambda from_: F.slice("cited_words", from_, F.greatest(F.col("n") - F.col("p"), F.lit(1)).cast("int"))
    whole = (F.col("p") < F.col("n")) & F.forall(F.zip_with(rest(F.lit(1)), rest((F.col("p") + 1).cast("int")), lambda a, b: F.coalesce(profile.same_word(a, b), F.lit(False))), lambda same: same)
    shortest = split.where(whole).groupBy("cand_id").agg(F.min_by(F.array_join(F.slice("cited_words", 1, F.col("p")), " "), "p").alias("phrase"))
    index = canon_index.index_of(passages, profile)
    asked = materialize(shortest.withColumn("cited", F.col("phrase")).withColumn("cited_words", F.split("phrase", " ")), "phrases")
    run = match.contiguous(asked, index).select("cand_id", "phrase", *match.PASSAGE)
    other = asked.join(run.select("cand_id").distinct(), "cand_id", "left_anti")
    soft = match.softly_anchored(other, index, profile, whole=True).where(align.soft_span(profile.drift)("canon", "cited_words")["start"].isNotNull())
    return run.unionByName(soft.select("cand_id", "phrase", *match.PASSAGE))


def corrected(found: DataFrame, kept: DataFrame, now: Column, passages: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Findings after the corrections kept for them, and those made without asking for verdicts in allowed.

    found: as scan() gives it, and url_key, prior_id. Adds correction, new_ref, new_text, prior_id and display (the colour
    shown). A reference is corrected to the passage matched, a text to the passage's own words for what is quoted (excerpt, where
    found has it), else to the passage; shaky findings keep their text.
    """
    asked = corrections.reapplied(found, kept, now)
    shaky = corrections.is_shaky(F.col("text"), F.col("refs"))
    target = F.when(F.col("verdict") == "orange", findings.nearest_in_claimed_group(F.col("refs"), F.col("claimed_group"), F.try_element_at("ords", F.lit(1)))).otherwise(F.try_element_at("refs", F.lit(1)))
    automatic = F.when(corrections.is_automatic(F.col("verdict"), shaky, F.lit(False), allowed) & target.isNotNull(), F.when(F.col("verdict") == "orange", "ref-edit").otherwise("text-replace"))
    own = passages.select(F.col("group_id").alias("_g"), F.col("ord").alias("_o"), F.col("ref").alias("_ref"), F.col("text").alias("_text"))
    out = asked.withColumn("correction", F.coalesce("correction", automatic)).withColumn("_t", target).withColumn("_shaky", shaky)
    out = out.join(canon_side(own, passages), (F.col("_t.group_id") == F.col("_g")) & (F.col("_t.ord") == F.col("_o")), "left")
    edits_ref, edits_text = F.col("correction").isin("ref-edit", "reference-attribution"), (F.col("correction") == "text-replace") & ~F.col("_shaky")
    new_ref = F.when(edits_ref & F.col("_ref").isNotNull(), F.when(F.col("ref").isNotNull(), labels.corrected_ref(F.col("ref"), F.col("_ref"))).otherwise(F.concat(F.lit("("), "_ref", F.lit(")"))))
    done = new_ref.isNotNull() | (edits_text & F.col("_text").isNotNull())
    out = out.withColumn("new_ref", new_ref).withColumn("new_text", F.when(edits_text, F.coalesce("excerpt", "_text") if "excerpt" in found.columns else F.col("_text")))
    out = out.withColumn("display", F.when(done & (F.col("correction") != "reference-attribution"), "lightGreen").otherwise(F.col("verdict")))
    successor = F.when(done & (F.col("correction") == "ref-edit"), labels.finding_id(F.col("text"), F.col("new_ref"), F.col("_ref"), F.concat_ws(":", "start", "end")))
    out = out.withColumn("prior_id", F.when(successor.isNotNull(), F.col("id")).otherwise(F.col("prior_id"))).withColumn("id", F.coalesce(successor, F.col("id")))
    return out.drop("_t", "_shaky", "_g", "_o", "_ref", "_text", "payload")


def reverified(fixed: DataFrame, passages: DataFrame, names: DataFrame, profile: Profile) -> DataFrame:
    """fixed (as corrected() gives it) with now: the verdict on a finding whose reference was corrected, by its new reference."""
    fixed = materialize(fixed, "fixed")
    key = ["page_id", "start", "end"]
    asked = references.resolved(fixed.where("new_ref is not null").select(F.struct(*key).alias("cand_id"), "text", F.col("new_ref").alias("ref")), names, profile).withColumn("high", F.lit(True))
    now = verify.memoized(asked, passages, profile).select("cand_id", F.col("verdict").alias("now"))
    return fixed.withColumn("cand_id", F.struct(*key)).join(now, "cand_id", "left").drop("cand_id")


def accepted(changes: DataFrame, passages: DataFrame, names: DataFrame, profile: Profile) -> DataFrame:
    """The changes that may be kept: a reference (ref) has to name passages of the canon, a text (text) to be wording of it; null ones are not asked."""
    changes = materialize(changes.withColumn("cand_id", F.monotonically_increasing_id()), "changes")
    asked = references.resolved(changes, names, profile)
    ords = asked.where("ref is not null and claimed_group is not null").select("cand_id", F.col("claimed_group").alias("group_id"), F.explode("ords").alias("ord"))
    known = ords.join(canon_side(passages.select(*match.PASSAGE), passages), match.PASSAGE).select("cand_id").distinct().withColumn("named", F.lit(True))
    texts = changes.where("trim(text) <> ''").select("cand_id", "text", F.lit(True).alias("high"), F.lit(None).cast("int").alias("claimed_group"), *[F.lit(None).cast("array<int>").alias(c) for c in ("ords", "range_ords")])
    worded = verify.memoized(texts, passages, profile).where("verdict in ('green', 'lightBlue')").select("cand_id", F.lit(True).alias("worded"))
    both = changes.join(known, "cand_id", "left").join(worded, "cand_id", "left")
    return both.where("(coalesce(trim(ref), '') = '' or named) and (coalesce(trim(text), '') = '' or worded)").drop("cand_id", "named", "worded")
