"""Finding passages in texts and texts in passages, by joins with an index of the canon.

candidates: cand_id (each once), cited (comparison form), cited_words. canon: passages as made by sources.corpus, or their CanonIndex.
A candidate is looked up by the rarest of the keys that a passage must share with it, never by its common words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.profiles import LATIN, Profile
from quotelens.functions.windows import canon_side, if_small, runs
from quotelens.operators import canon_index
from quotelens.operators.canon_index import LETTERS, PAIR, PASSAGE, WORD, CanonIndex, index_of, key, option, probed
from quotelens.store import materialize


#: Words of the runs by which texts are searched for passages.
ANCHOR = 4


def with_words(texts: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    out = texts.withColumn("cited", profile.cited(F.col(text)))
    return out.withColumn("cited_words", profile.words(F.col("cited")))


def passages_within(texts: DataFrame, keys: list[str], passages: DataFrame) -> DataFrame:
    """keys, group_id, ord and place: where a text holds a whole passage. texts: keys and cited_words.

    Of each passage the run of ANCHOR words that is rarest in the canon is looked for in the texts (a shorter passage is its
    own run); where it lies, the whole passage is compared.
    """
    n = F.size("t1_words")
    begin = (F.col("place") - F.col("at")).alias("place")
    sized = passages.select(*PASSAGE, "t1_words", F.least(n, F.lit(ANCHOR)).alias("n")).where("n > 0")
    met = texts.select(*keys, F.lit(None).cast("int").alias("group_id"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("place")).limit(0)
    for (length,) in sized.select("n").distinct().collect():  # ANCHOR values at most
        every = runs(sized.where(F.col("n") == length), PASSAGE, "t1_words", length)
        often = every.groupBy("run").agg(F.count("*").alias("often"))
        anchors = every.join(often, "run").groupBy(*PASSAGE).agg(F.min_by(F.struct("run", "place"), F.struct("often", "place")).alias("a")).select(*PASSAGE, "a.run", F.col("a.place").alias("at"))
        met = met.unionByName(runs(texts, keys, "cited_words", length).join(canon_side(anchors, passages), "run").select(*keys, *PASSAGE, begin))
    # few of all texts hold an anchor: written, so that they are found once
    met = materialize(met.where("place >= 0").distinct().select(F.struct(*keys).alias("_of"), *PASSAGE, "place"), "met")
    met = if_small(met, 100_000)
    said = texts.select(*keys, "cited_words").join(met, F.struct(*keys).eqNullSafe(F.col("_of"))).drop("_of")
    whole = said.join(canon_side(passages.select(*PASSAGE, "t1_words"), passages), PASSAGE).where(F.slice("cited_words", F.col("place") + 1, n) == F.col("t1_words"))
    return whole.select(*keys, *PASSAGE, "place").distinct()


def exact(candidates: DataFrame, canon: DataFrame | CanonIndex) -> DataFrame:
    forms = index_of(canon, LATIN).side("forms").select(F.col("t1").alias("_t1"), *PASSAGE)
    return candidates.join(forms, F.col("cited") == F.col("_t1")).drop("_t1")


def _with_canon(candidates: DataFrame, found: DataFrame, index: CanonIndex, **columns: str) -> DataFrame:
    """candidates with the passages found for them (cand_id, group_id, ord), and columns of the passages under new names."""
    own = index.side("passages").select(*PASSAGE, *[F.col(old).alias(new) for new, old in columns.items()])
    return candidates.join(found.join(own, PASSAGE), "cand_id")


def _asked(candidates: DataFrame, *options: Column) -> DataFrame:
    return candidates.select("cand_id", F.array(*options).alias("options"))


def _first(words: str = "cited_words") -> Column:
    return F.try_element_at(F.col(words), F.lit(1))


def _last(words: str = "cited_words") -> Column:
    return F.try_element_at(F.col(words), F.lit(-1))


def anchored(candidates: DataFrame, canon: DataFrame | CanonIndex) -> DataFrame:
    """Candidates of two words or more with the passages that have both their first and last word."""
    index = index_of(canon, LATIN)
    c = candidates.where(F.size("cited_words") >= 2)
    found = probed(_asked(c, *[option(F.array(key(WORD, w))) for w in (_first(), _last())]), index)
    both = F.array_contains("_canon", _first()) & F.array_contains("_canon", _last())
    return _with_canon(c, found, index, _canon="t1_words").where(both).select(*candidates.columns, *PASSAGE)


def _heads(most: int, profile: Profile, last: bool = False) -> Column:
    """A candidate's first one to most words, or its last ones, written as one."""
    n = F.size("cited_words")
    part = lambda k: F.slice("cited_words", n - k + 1, k) if last else F.slice("cited_words", F.lit(1), k)
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n)), lambda k: F.array_join(part(k), ""))


def _bones(kind: str, texts: Column, profile: Profile) -> Column:
    return F.transform(texts, lambda w: key(canon_index.soft_kind(kind, profile), profile.skeleton(w)))


def alike(a: Column, b: Column, profile: Profile) -> Column:
    """Whether two words are one by the letter that looking them up allows for."""
    return (a == b) | (profile.same_word(a, b) & (F.levenshtein(a, b) <= 1)) if profile.drift else a == b


def has_alike(words: Column, forms: Column, profile: Profile) -> Column:
    if not profile.drift:
        return F.arrays_overlap(words, forms)
    return F.exists(words, lambda w: F.exists(forms, lambda f: alike(f, w, profile)))


def kept_options(n: Column, edits: Column, profile: Profile, lost_pairs: int = 0) -> list[Column]:
    """Options for passages that have all of a candidate's words but edits of them: one of any edits + 1 words is kept.

    Each edit parts two pairs of neighbours, so one of any 2 * edits + 1 pairs is kept too (and lost_pairs more, if those are lost).
    """
    words, pairs = F.col("cited_words"), canon_index.neighbours(F.transform("cited_words", lambda w: profile.skeleton(w)))
    few = 2 * edits + lost_pairs
    by_word = F.when(n > edits, option(_bones(WORD, words, profile), edits + 1))
    by_pair = F.when(n - 1 > few, option(F.transform(pairs, lambda p: key(canon_index.soft_kind(PAIR, profile), p)), few + 1))
    return [by_word, by_pair]


def softly_anchored(candidates: DataFrame, canon: DataFrame | CanonIndex, profile: Profile, most: int = 3, edits: Column | None = None, whole: bool = False) -> DataFrame:
    """Candidates of two words or more with the passages that have a word like their first one, and one like their last one; and canon, the passage's words.

    A word may be written in up to most words of the citation, and differ in one letter of the profile's drift. edits: only
    passages matter that have all words but so many. whole: only those that write all of it, whatever words are merged or split.
    Passages are looked up by whichever is rarest: the words at either end, words or pairs that not all edits can touch, or a run of letters.
    """
    index = index_of(canon, profile)
    c = candidates.where(F.size("cited_words") >= 2)
    options = [option(_bones(WORD, _heads(most, profile, last), profile)) for last in (False, True)]
    if edits is not None:
        options += kept_options(F.size("cited_words"), edits, profile)
    flat = canon_index.letters(F.col("cited_words"), profile)
    if whole:
        options.append(F.when(F.length(flat) >= canon_index.GRAM, option(F.transform(canon_index.grams(flat), lambda g: key(LETTERS, g)), F.lit(1))))
    met = _with_canon(c, probed(_asked(c, *options), index), index, canon="t1_words")
    if whole:
        met = met.where(F.contains(canon_index.letters(F.col("canon"), profile), flat))
    fits = has_alike(F.col("canon"), _heads(most, profile), profile) & has_alike(F.col("canon"), _heads(most, profile, True), profile)
    return met.where(fits).select(*candidates.columns, *PASSAGE, "canon")


def contiguous(candidates: DataFrame, canon: DataFrame | CanonIndex, cut: bool = False) -> DataFrame:
    """Candidates of two words or more that are a run of a passage, word for word; with cut the last word may go on in the passage."""
    index = index_of(canon, LATIN)
    c = candidates.where(F.size("cited_words") >= 2)
    words = F.slice("cited_words", F.lit(1), F.size("cited_words") - 1) if cut else F.col("cited_words")
    by_pair = F.when(F.size(words) > 1, option(F.transform(canon_index.neighbours(words), lambda p: key(PAIR, p)), F.lit(1)))
    found = probed(_asked(c, by_pair, option(F.transform(words, lambda w: key(WORD, w)), F.lit(1))), index)
    pad = lambda x, end: F.concat(F.lit(" "), x, F.lit(end))
    end = "" if cut else " "
    return _with_canon(c, found, index, _t1="t1").where(F.contains(pad(F.col("_t1"), end), pad(F.col("cited"), end))).select(*candidates.columns, *PASSAGE)


def spelling_variants(words: DataFrame, vocabulary: DataFrame, profile: Profile) -> DataFrame:
    """word and variant: words of the vocabulary that write the same; a word's exact form hides its variants."""
    keyed = words.select("word", profile.skeleton(F.col("word")).alias("skeleton")).distinct()
    known = vocabulary.select(F.col("word").alias("variant"), profile.skeleton(F.col("word")).alias("skeleton")).distinct()
    near = keyed.join(known, "skeleton").where(profile.same_word(F.col("word"), F.col("variant")) & (F.levenshtein("word", "variant") <= 1))
    exact_ones = near.where("word = variant").select("word")
    return near.join(exact_ones, "word", "left_anti").unionByName(near.where("word = variant")).select("word", "variant")


def bag_matches(candidates: DataFrame, canon: DataFrame | CanonIndex) -> DataFrame:
    """Candidates with the passages that hold at least half of their words (two at least), counted with repeats.

    A passage that holds that many holds one of the rarest others and one more, so only these are joined, never the common words.
    """
    index = index_of(canon, LATIN)
    n = F.size("cited_words")
    least = F.greatest(F.lit(2), F.ceil(n * 0.5)).cast("int")
    asked = candidates.where(n >= 2)
    found = probed(_asked(asked, option(F.transform("cited_words", lambda w: key(WORD, w)), n - least + 1)), index)
    counted = _with_canon(asked.select("cand_id", "cited_words", least.alias("least")), found, index, _words="t1_words")
    counted = counted.withColumn("shared", F.size(F.filter("cited_words", lambda w: F.array_contains(F.col("_words"), w))).cast("long"))
    return counted.where("shared >= least").select("cand_id", *PASSAGE, "shared")


def with_word(candidates: DataFrame, canon: DataFrame | CanonIndex, most: Column) -> DataFrame:
    """Candidates of one word with the passages that have it, if these are at most so many (any number where most is null)."""
    index = index_of(canon, LATIN)
    c = candidates.where(F.size("cited_words") == 1).withColumn("_key", key(WORD, _first())).withColumn("_most", most)
    kept = c.join(index.side("counts"), F.col("_key") == F.col("key")).where("_most is null or often <= _most").drop("often", "key", "_most")
    parts = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("_key", "key").drop("parts")
    return parts.join(index.side("postings"), ["key", "part"]).drop("key", "part")


def elsewhere(found: DataFrame, claims: DataFrame) -> DataFrame:
    """Matches outside of the claimed passages. claims: cand_id, group_id, ord."""
    return found.join(claims.select("cand_id", *PASSAGE), ["cand_id", *PASSAGE], "left_anti")


def allowed_edits(n: Column, loose: bool = False) -> Column:
    return (F.greatest(F.lit(2), F.ceil(n / 4)) if loose else F.greatest(F.lit(1), F.floor(n / 8))).cast("int")
