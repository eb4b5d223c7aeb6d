"""Suggestions to a writer: passages that what has been written so far may quote, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.labels import verdict_of_tier
from quotelens.functions.profiles import Profile
from quotelens.functions.windows import canon_side
from quotelens.operators import align, match
from quotelens.operators.canon_index import PASSAGE, WORD, CanonIndex, index_of, key
from quotelens.store import materialize

DEFAULT, MOST, ALL = 8, 50, 500
#: Letters by which words of the canon are looked up that begin as a cut word does.
BEGINNING = 2


def begun_words(words: DataFrame, index: CanonIndex) -> DataFrame:
    """word and whole: the words of the canon that begin with word (a column of words of BEGINNING letters or more)."""
    known = index.side("counts").where(F.startswith("key", F.lit(WORD))).select(F.substring("key", 2, 2**31 - 1).alias("whole"))
    begin = lambda c: F.substring(c, 1, BEGINNING).alias("_begin")
    found = words.select("word", begin("word")).distinct().join(known.select("whole", begin("whole")), "_begin")
    return found.where(F.startswith("whole", "word")).select("word", "whole")


def _exact(c: DataFrame, index: CanonIndex) -> DataFrame:
    """cand_id, group_id and ord of passages with a run of the words, of which the last may be cut short."""
    several = match.contiguous(c, index, cut=True).select("cand_id", *PASSAGE)
    one = c.where("n = 1").select("cand_id", F.element_at("cited_words", 1).alias("word"))
    # a shorter word stands for itself
    whole = begun_words(one.where(F.length("word") >= BEGINNING), index).unionByName(one.where(F.length("word") < BEGINNING).select("word", F.col("word").alias("whole")).distinct())
    keys = one.join(whole, "word").select("cand_id", key(WORD, F.col("whole")).alias("key")).join(index.side("counts"), "key")
    parts = keys.select("cand_id", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return several.unionByName(parts.join(index.side("postings"), ["key", "part"]).select("cand_id", *PASSAGE)).distinct()


def _tiers(c: DataFrame, index: CanonIndex, profile: Profile, top: int, fuzzy: bool) -> DataFrame:
    """cand_id, group_id, ord and tier; a later tier is only looked at for candidates that the earlier ones leave room for."""
    found = _exact(c, index).withColumn("tier", F.lit(0))
    if not fuzzy:
        return found
    few = match.allowed_edits(F.col("n"), True)
    soft = lambda rest: match.softly_anchored(rest, index, profile, whole=True).where(align.soft_span(profile.drift)("canon", "cited_words")["start"].isNotNull())
    loose = lambda rest: match.softly_anchored(rest, index, profile, edits=few).where(align.window_distance(profile.drift)("cited_words", "canon", few) > 0)
    found = materialize(found, "tiers")
    for tier, way in ((1, soft), (2, loose)):
        full = found.groupBy("cand_id").agg(F.countDistinct(*PASSAGE).alias("_found")).where(F.col("_found") >= top).select("cand_id")
        more = way(c.join(full, "cand_id", "left_anti")).select("cand_id", *PASSAGE, F.lit(tier).alias("tier"))
        found = found.unionByName(materialize(more, "tiers"))
    return found.groupBy("cand_id", *PASSAGE).agg(F.min("tier").alias("tier"))


def suggestions(prefixes: DataFrame, canon: DataFrame | CanonIndex, profile: Profile, limit: int = DEFAULT, least_words: int = 2, fuzzy: bool = True) -> DataFrame:
    """prefixes: cand_id, text. cand_id, rank (from 0), group_id, ord, tier, coverage.

    Tier 0 holds the text as a run of words, of which the last may be cut short; tier 1 as a run that differs in spelling only
    (letters that may drop, words merged or split); tier 2 has a first and a last word like the text's and differs in a few words. A passage
    counts in its best tier. Where nothing is found, the text is tried without its last word. limit 0 means all up to ALL.
    """
    top = ALL if limit == 0 else min(limit, MOST)
    index = index_of(canon, profile)
    c = match.with_words(prefixes, profile).withColumn("n", F.size("cited_words")).where(F.col("n") >= least_words).select("cand_id", "cited", "cited_words", "n")
    # written, since each tier reads them, and what is found
    c = materialize(c, "prefixes") if fuzzy else c
    found = _tiers(c, index, profile, top, fuzzy).join(c.select("cand_id", "n"), "cand_id")
    if fuzzy:
        words = F.slice("cited_words", F.lit(1), F.col("n") - 1)
        shorter = c.where("n > 1").join(found.select("cand_id").distinct(), "cand_id", "left_anti").select("cand_id", F.array_join(words, " ").alias("cited"), words.alias("cited_words"), (F.col("n") - 1).alias("n"))
        shorter = materialize(shorter, "shorter")
        found = found if shorter.isEmpty() else found.unionByName(_tiers(shorter, index, profile, top, fuzzy).join(shorter.select("cand_id", "n"), "cand_id"))
    sized = found.join(index.side("passages").select(*PASSAGE, F.size("t1_words").alias("m")), PASSAGE)
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("cand_id").orderBy("tier", *PASSAGE)) - 1).where(F.col("rank") < top)
    return ranked.select("cand_id", "rank", *PASSAGE, "tier", F.round(F.least("n", "m") / F.col("m"), 3).alias("coverage"))


def passed_over(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """What is said of a text whose suggestions were all passed over: cand_id, verdict and ref of the first of them."""
    best = ranked.where("rank = 0").join(canon_side(passages.select(*PASSAGE, "ref"), passages), PASSAGE)
    return best.select("cand_id", verdict_of_tier(F.col("tier")).alias("verdict"), "ref")


def inserted_text(chosen: DataFrame, scope: str = "whole") -> DataFrame:
    """chosen: text (of the passage), typed_words, group_name, first, last. Adds body: what is put in place of the typed text, with its reference."""
    words = F.split("text", " ")
    body = F.array_join(F.slice(words, 1, F.least(F.col("typed_words"), F.size(words))), " ") if scope == "typedPortion" else F.col("text")
    ref = F.concat(F.lit("("), F.col("group_name"), F.lit(":"), F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit("-"), F.col("last").cast("string"))).otherwise(F.lit("")), F.lit(")"))
    return chosen.withColumn("body", F.concat(F.lit("{"), body, F.lit("} "), ref))
