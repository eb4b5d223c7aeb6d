"""Verdicts on quotations: every way in which a quotation can match is a table, and the first way by rank decides.

candidates: cand_id, text, high (whether the text is surely meant as a quotation), claimed_group, ords (the passages that
it is said to be; null without a claim) and range_ords (a wider reading of the claim, or null). All ways are joins that
are blocked by words or by the claim; only alignments with spelling variants run in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.profiles import Profile
from quotelens.operators import align, canon_index, match
from quotelens.operators.canon_index import PASSAGE, CanonIndex, index_of, option, probed
from quotelens.store import materialize

#: References that a verdict lists at most, of single words and of wordings that differ.
MOST_SINGLE, MOST_PARTIAL, MOST_SPAN = 8, 3, 30


def _hit(df: DataFrame, rank: Column, verdict: Column, kind: str, deviation: Column, diffs: Column | None = None) -> DataFrame:
    diffs = F.lit(0) if diffs is None else diffs
    return df.select("cand_id", rank.alias("rank"), verdict.alias("verdict"), F.lit(kind).alias("match_type"), deviation.alias("deviation"), diffs.cast("int").alias("diffs"), *PASSAGE)


def claimed_passages(candidates: DataFrame, index: CanonIndex) -> DataFrame:
    """A row for each candidate and reading of its claim (0: ords, 1: range_ords) whose passages are in the canon.

    The columns of candidates, and reading, canon (the passages' words), whole (their form), authentic and found_ords.
    """
    readings = F.posexplode(F.array("ords", "range_ords")).alias("reading", "_ords")
    claims = candidates.select("cand_id", F.col("claimed_group").alias("group_id"), readings).where("size(_ords) > 0").select("cand_id", "group_id", "reading", F.posexplode("_ords").alias("nth", "ord"))
    found = claims.join(index.side("passages", *PASSAGE, "t1", "t1_words", "text"), PASSAGE)
    found = found.groupBy("cand_id", "reading").agg(F.array_sort(F.collect_list(F.struct("nth", "ord", "t1", "t1_words", "text"))).alias("p"))
    joined = found.select("cand_id", "reading", F.flatten(F.transform("p", lambda x: x["t1_words"])).alias("canon"), F.array_join(F.transform("p", lambda x: x["t1"]), " ").alias("whole"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("authentic"), F.transform("p", lambda x: x["ord"]).alias("found_ords"))
    return candidates.join(joined, "cand_id")


def part_matches(parts: DataFrame, index: CanonIndex, profile: Profile) -> DataFrame:
    """Passages of the parts of quotations (cand_id and their words): the whole passage, else a run of it word for word, else one in other spelling.

    A part of one word has the passages with a word like it.
    """
    parts = materialize(parts, "parts")
    several, single = parts.where(F.size("cited_words") > 1), parts.where(F.size("cited_words") == 1)
    columns = ["cand_id", *PASSAGE]
    whole = match.exact(several, index).select(*columns)
    rest = several.join(whole.select("cand_id").distinct(), "cand_id", "left_anti")
    run = match.contiguous(rest, index).select(*columns)
    rest = rest.join(run.select("cand_id").distinct(), "cand_id", "left_anti")
    soft = match.softly_anchored(rest, index, profile, whole=True).where(align.soft_span(profile.drift)("canon", "cited_words")["start"].isNotNull()).select(*columns)
    kind = canon_index.soft_kind(canon_index.WORD, profile)
    met = probed(single.select("cand_id", F.array(option(F.transform("cited_words", lambda w: canon_index.key(kind, profile.skeleton(w))))).alias("options")), index)
    met = single.join(met.join(index.side("passages", *PASSAGE, "t1_words"), PASSAGE), "cand_id")
    word = met.where(match.has_alike(F.col("t1_words"), F.col("cited_words"), profile)).select(*columns)
    return reduce(DataFrame.unionByName, (whole, run, soft, word))


def segment_matches(candidates: DataFrame, canon: DataFrame | CanonIndex, profile: Profile) -> DataFrame:
    """Quotations in parts with asterisks between: the passages of one group in which the parts follow one another. cand_id, group_id, ords.

    Of every passage that the first part is in, the next ones that have the other parts make a chain of at most MOST_SPAN
    passages. The chain whose words are nearest to the quotation's wins, then the shortest, then the first.
    """
    index = index_of(canon, profile)
    cut = F.filter(F.split("text", r"\*+"), lambda s: F.length(profile.form(s)) > 0)
    whole = candidates.where(F.contains("text", F.lit("*"))).select(F.col("cand_id").alias("whole_id"), cut.alias("_cut")).where(F.size("_cut") > 1)
    parts = match.with_words(whole.select("whole_id", F.posexplode("_cut").alias("nth", "text")), profile).withColumn("cand_id", F.struct("whole_id", "nth"))
    found = part_matches(parts.select("cand_id", "cited", "cited_words"), index, profile).select("cand_id.*", *PASSAGE)
    each = found.groupBy("whole_id", "group_id", "nth").agg(F.array_sort(F.collect_set("ord")).alias("at"))
    rows = each.groupBy("whole_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("nth", "at"))).alias("parts"))
    rows = rows.join(whole.select("whole_id", F.size("_cut").alias("n")), "whole_id").where("size(parts) = n")
    follow = lambda taken, part: F.when(taken.isNull(), taken).otherwise(F.concat(taken, F.slice(F.filter(part["at"], lambda o: o > F.element_at(taken, -1)), 1, 1)))
    chain = lambda first: F.aggregate(F.slice("parts", F.lit(2), F.col("n") - 1), F.array(first), follow)
    chains = rows.withColumn("ords", F.explode(F.transform(F.col("parts")[0]["at"], chain)))
    chains = chains.where("size(ords) = n").withColumn("span", F.element_at("ords", -1) - F.element_at("ords", 1)).where(F.col("span") <= MOST_SPAN)
    said = parts.groupBy("whole_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "cited_words"))), lambda p: p["cited_words"])).alias("said"))
    chains = chains.select("whole_id", "group_id", "ords", "span").distinct()
    words = chains.select("whole_id", "group_id", "ords", F.posexplode("ords").alias("nth", "ord")).join(index.side("passages", *PASSAGE, "t1_words"), PASSAGE)
    words = words.groupBy("whole_id", "group_id", "ords").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "t1_words"))), lambda p: p["t1_words"])).alias("canon"))
    scored = words.join(said, "whole_id").withColumn("diffs", align.window_distance(profile.drift)("said", "canon", match.allowed_edits(F.size("said"), True)))
    rank = F.struct(F.coalesce("diffs", F.lit(2**31 - 1)).alias("diffs"), (F.element_at("ords", -1) - F.element_at("ords", 1)).alias("span"), "group_id", "ords")
    return scored.groupBy("whole_id").agg(F.min(rank).alias("b")).select(F.col("whole_id").alias("cand_id"), "b.group_id", "b.ords")


def verdicts(candidates: DataFrame, canon: DataFrame | CanonIndex, profile: Profile) -> DataFrame:
    """cand_id, verdict, match_type, deviation, diffs and refs (group_id and ord of the passages matched, in order).

    Candidates that are no quotations (no match, and not high) have no row. Equal candidates should be made one first.
    """
    index = index_of(canon, profile)
    c = match.with_words(candidates, profile).withColumn("n", F.size("cited_words")).withColumn("bound", F.col("claimed_group").isNotNull() & (F.coalesce(F.size("ords"), F.lit(0)) > 0))
    n, high, bound = F.col("n"), F.col("high"), F.col("bound")
    by_claim = lambda with_claim, without: F.when(bound, F.lit(with_claim)).otherwise(F.lit(without))
    elsewhere = ~bound | ~((F.col("group_id") == F.col("claimed_group")) & F.array_contains("ords", F.col("ord")))
    drifted, worded = F.lit("spellingDrift"), F.lit("wordLevel")
    soft, apart, ordered = align.soft_span(profile.drift), align.window_distance(profile.drift), align.ordered_segments(profile.drift)
    texts = index.side("passages").select(*PASSAGE, F.col("text").alias("authentic"))
    words = index.side("passages").select(*PASSAGE, F.col("t1_words").alias("canon"))

    # the cheap ways first: an exact passage, or the claimed one; who has such a hit has none of a lower rank, and asks no further
    same = match.exact(c, index).where(elsewhere).join(texts, PASSAGE)
    cut = F.transform(F.filter(F.split("text", r"\.{3,}|…"), lambda s: F.length(profile.form(s)) > 0), lambda s: profile.words(profile.form(s)))
    held = claimed_passages(c.where("bound"), index).withColumn("group_id", F.col("claimed_group")).withColumn("_cut", cut)
    held = held.select("*", soft("canon", "cited_words").alias("_run"), ordered("canon", "_cut").alias("_parts"), apart("cited_words", "canon", match.allowed_edits(n)).alias("_d"))
    whole, pieces, near = (F.col("cited") == F.col("whole")) | F.col("_run.start").isNotNull(), (F.size("_cut") > 1) & F.col("_parts"), (n > 1) & F.col("_d").isNotNull()
    held = held.where(whole | pieces | near).withColumn("ord", F.explode("found_ords"))
    green = whole | pieces
    right = F.when(F.col("cited") == F.col("whole"), profile.deviation(F.col("text"), F.col("authentic"))).otherwise(drifted)

    sure = [
        _hit(same, by_claim(14, 1), by_claim("orange", "lightBlue"), "exact", F.when(bound, "none").otherwise(profile.deviation(F.col("text"), F.col("authentic")))),
        _hit(held.where(green), F.when(whole, 10).otherwise(12) + F.col("reading"), F.lit("green"), "exact", right),
    ]
    sure = materialize(reduce(DataFrame.unionByName, sure), "sure")
    c = materialize(c.join(sure.select("cand_id").distinct(), "cand_id", "left_anti"), "unsure")
    run = match.contiguous(c, index).where(elsewhere & (~bound | high))
    loose = match.softly_anchored(c, index, profile, whole=True).where(elsewhere & (~bound | high)).where(soft("canon", "cited_words")["start"].isNotNull())
    bags = match.bag_matches(c, index).join(words, PASSAGE).join(c.select("cand_id", "cited_words", "n", "bound"), "cand_id").withColumn("_d", apart("cited_words", "canon", match.allowed_edits(n))).where("_d is not null")
    single = match.with_word(c.where(~bound | high), index, F.when(bound | ~high, MOST_SINGLE)).where(elsewhere)
    segments = materialize(segment_matches(c, index, profile), "segments")
    parts = c.select("cand_id", "bound", "claimed_group", F.col("ords").alias("claimed")).join(segments, "cand_id").withColumn("ord", F.explode("ords"))
    as_claimed = (F.col("group_id") == F.col("claimed_group")) & (F.array_sort(F.array_distinct("claimed")) == F.array_sort(F.array_distinct("ords")))

    hits = [
        sure,
        _hit(parts, by_claim(17, 2), F.when(~bound, "lightBlue").when(as_claimed, "green").otherwise("orange"), "orderedContiguous", drifted),
        _hit(run, by_claim(19, 3), by_claim("orange", "lightBlue"), "orderedContiguous", drifted),
        _hit(loose, by_claim(20, 4), by_claim("orange", "lightBlue"), "orderedContiguous", drifted),
        _hit(single, by_claim(18, 5), by_claim("orange", "lightBlue"), "partial", drifted),
        _hit(bags, by_claim(21, 6), F.lit("yellow"), "partial", worded, F.col("_d")),
        _hit(held.where(~green).join(sure.select("cand_id").distinct(), "cand_id", "left_anti"), F.lit(15) + F.col("reading"), F.lit("yellow"), "partial", worded, F.col("_d")),
        c.where(high).select("cand_id", F.lit(99).alias("rank"), F.lit("red").alias("verdict"), F.lit("none").alias("match_type"), F.lit(None).cast("string").alias("deviation"), F.lit(0).alias("diffs"), F.lit(None).cast("int").alias("group_id"), F.lit(None).cast("int").alias("ord")),
    ]
    # of single words and of wordings that differ only those that are listed are kept, by a window that needs no more of them
    listed = Window.partitionBy("cand_id", "rank").orderBy("diffs", *PASSAGE)
    most = F.when(F.col("verdict") == "yellow", MOST_PARTIAL).otherwise(MOST_SINGLE)
    every = materialize(reduce(DataFrame.unionByName, hits), "hits")
    partial = every.where("match_type = 'partial'").distinct().withColumn("_n", F.row_number().over(listed)).where(F.col("_n") <= MOST_SINGLE).where(F.col("_n") <= most).drop("_n")
    ranked = every.where("match_type <> 'partial'").unionByName(partial).groupBy("cand_id", "rank").agg(F.min(F.struct("diffs", *PASSAGE, "verdict", "match_type", "deviation")).alias("best"), F.array_sort(F.collect_set(F.when(F.col("ord").isNotNull(), F.struct("diffs", *PASSAGE)))).alias("refs"))
    first = ranked.groupBy("cand_id").agg(F.min(F.struct("rank", "best", "refs")).alias("w"))
    best = F.col("w.best")
    return first.select("cand_id", best["verdict"].alias("verdict"), best["match_type"].alias("match_type"), best["deviation"].alias("deviation"), best["diffs"].alias("diffs"), F.transform("w.refs", lambda r: F.struct(r["group_id"].alias("group_id"), r["ord"].alias("ord"))).alias("refs"))


def memoized(candidates: DataFrame, canon: DataFrame | CanonIndex, profile: Profile) -> DataFrame:
    """verdicts() made once for each different candidate, for all of them. Candidates are written once, since every way of matching reads them."""
    index = index_of(canon, profile)
    key = ["text", "high", "claimed_group", "ords", "range_ords"]
    asked = materialize(candidates.select("cand_id", *key), "asked")
    # numbered in a written table, so that the numbers stay
    once = materialize(asked.select(*key).distinct().withColumn("_id", F.monotonically_increasing_id()), "candidates")
    judged = verdicts(once.withColumnRenamed("_id", "cand_id"), index, profile).withColumnRenamed("cand_id", "_id")
    known = once.select("_id", *[F.col(k).alias(f"_{k}") for k in key]).join(judged, "_id").drop("_id")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return asked.join(known, same).drop(*key, *[f"_{k}" for k in key])


def alternates(candidates: DataFrame, canon: DataFrame | CanonIndex, profile: Profile) -> DataFrame:
    """All passages that hold a quotation, and those that hold it but for a few words: cand_id, group_id, ord and exact, only for the candidates asked for.

    candidates: cand_id, text.
    """
    index = index_of(canon, profile)
    c = match.with_words(candidates, profile).withColumn("n", F.size("cited_words"))
    few = match.allowed_edits(F.col("n"), True)
    held = match.softly_anchored(c, index, profile, whole=True).where(align.soft_span(profile.drift)("canon", "cited_words")["start"].isNotNull())
    near = match.softly_anchored(c, index, profile, edits=few).where(align.window_distance(profile.drift)("cited_words", "canon", few) > 0)
    named = lambda df, exact: df.select("cand_id", *PASSAGE, F.lit(exact).alias("exact"))
    every = named(match.exact(c, index), True).unionByName(named(held, True)).unionByName(named(near, False))
    return every.groupBy("cand_id", *PASSAGE).agg(F.bool_or("exact").alias("exact"))


def crossing_matches(c: DataFrame, index: CanonIndex, profile: Profile, most: int = 7, words: int = 40) -> DataFrame:
    """Runs of two to most neighbouring passages of which the first one has the candidate's first word and the last one its last: the columns of c, group_id, first, last and canon.

    A run matters only if all of the candidate's words but a few are in it, so at least one of its passages has one of the
    candidate's rarest words, or pairs; a pair can also be lost between two passages.
    """
    short = c.where(F.col("n").between(2, words))
    ends = [F.slice("cited_words", F.lit(1), F.lit(1)), F.slice("cited_words", F.size("cited_words"), F.lit(1))]
    bones = lambda texts: F.transform(texts, lambda w: canon_index.key(canon_index.soft_kind(canon_index.WORD, profile), profile.skeleton(w)))
    options = [option(bones(e)) for e in ends] + match.kept_options(F.col("n"), match.allowed_edits(F.col("n"), True), profile, most - 1)
    met = probed(short.select("cand_id", F.array(*options).alias("options")), index)
    spans = met.withColumn("first", F.explode(F.sequence(F.col("ord") - most + 1, F.col("ord")))).withColumn("last", F.explode(F.sequence(F.greatest("ord", F.col("first") + 1), F.col("first") + most - 1)))
    spans = spans.select("cand_id", "group_id", "first", "last").distinct().join(short.select("cand_id", *[e.alias(f"_e{i}") for i, e in enumerate(ends)]), "cand_id")
    own = index.side("passages", *PASSAGE, "t1_words")
    for i, end in enumerate(("first", "last")):
        spans = spans.join(own.select("group_id", F.col("ord").alias(end), F.col("t1_words").alias("_w")), ["group_id", end]).where(match.has_alike(F.col("_w"), F.col(f"_e{i}"), profile)).drop("_w")
    some = spans.select("group_id", "first", "last").distinct()
    each = some.withColumn("ord", F.explode(F.sequence("first", "last"))).join(own, PASSAGE).groupBy("group_id", "first", "last").agg(F.array_sort(F.collect_list(F.struct("ord", "t1_words"))).alias("p"))
    joined = each.where(F.size("p") == F.col("last") - F.col("first") + 1).select("group_id", "first", "last", F.flatten(F.transform("p", lambda x: x["t1_words"])).alias("canon"))
    return short.join(spans.select("cand_id", "group_id", "first", "last").join(joined, ["group_id", "first", "last"]), "cand_id")


def near_matches(red: DataFrame, canon: DataFrame | CanonIndex, profile: Profile, rivals: int = 1) -> DataFrame:
    """For quotations that weren't found: the closest passage, or run of neighbouring ones, with its edits.

    red: cand_id, text. cand_id, group_id, first, last, distance, diff and rivals (passages at most that much further away).
    Of the runs that begin with one passage the shortest that is near enough counts.
    """
    index = index_of(canon, profile)
    c = materialize(match.with_words(red, profile).withColumn("n", F.size("cited_words")).where("n > 1").select("cand_id", "cited_words", "n"), "red")
    apart, window = align.window_distance(profile.drift), align.best_window(profile.drift)
    few = match.allowed_edits(F.col("n"), True)
    columns = ["cand_id", "cited_words", "n", "group_id", "first", "last", "canon"]
    single = match.softly_anchored(c, index, profile, edits=few).withColumn("first", F.col("ord")).withColumn("last", F.col("ord")).select(columns)
    crossing = crossing_matches(c, index, profile).select(columns)
    scored = single.union(crossing).withColumn("distance", apart("cited_words", "canon", few)).where("distance > 0 or first < last and distance >= 0")
    # of runs that begin alike the shortest
    shortest = F.row_number().over(Window.partitionBy("cand_id", "group_id", "first", F.col("last") > F.col("first")).orderBy("last"))
    scored = materialize(scored.withColumn("_k", shortest).where("_k = 1").select("cand_id", "distance", "group_id", "first", "last", "cited_words", "canon"), "scored")
    order = F.struct("distance", (F.col("last") > F.col("first")).alias("crosses"), "group_id", "first", "last", "cited_words", "canon")
    best = scored.groupBy("cand_id").agg(F.min(order).alias("b"))
    other = ~((F.col("group_id") == F.col("b.group_id")) & (F.col("first") == F.col("b.first")))
    near = scored.select("cand_id", "distance", "group_id", "first").distinct().join(best, "cand_id").where(F.col("distance") <= F.col("b.distance") + rivals)
    count = near.groupBy("cand_id").agg(F.count_if(other).cast("int").alias("rivals"))
    found = best.join(count, "cand_id").select("cand_id", "b.group_id", "b.first", "b.last", "b.distance", window("b.cited_words", "b.canon", "b.canon").alias("w"), "rivals")
    return found.select("cand_id", "group_id", "first", "last", "distance", "w.diff", "rivals")
