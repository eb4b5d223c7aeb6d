"""The writer's side: what is being quoted before the caret, and the text that an accepted suggestion puts there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.labels import reference_text
from quotelens.functions.profiles import Profile, squeeze
from quotelens.functions.windows import canon_side
from quotelens.operators import align, extract
from quotelens.operators.references import passages_of_range

# Opening marks of a quotation and what closes them.
CLOSERS = {"{": "}", "«": "»", "[": "]", "(": ")", "<": ">", '"': '"', "“": "”", "‘": "’", "﴿": "﴾"}
#: How much of a passage a suggestion inserts.
SCOPES = ("whole", "typedPortion", "startToEndWord", "multiAyahs", "surahEnd")
WORD_CAP = 500


def begun_quotation(before_caret: Column) -> Column:
    """cited, open and close of the quotation that the text before a caret has begun; null if it has none, or closed it.

    The last opening mark or introducing phrase counts.
    """
    opens = "".join(f"\\{c}" for c in CLOSERS)
    closes = "".join(f"\\{c}" for c in CLOSERS.values())
    text = F.translate(before_caret, "\0", " ")
    by_mark = F.regexp_extract(text, rf"(?s)^.*([{opens}])([^{opens}{closes}]*)$", 1)
    after_mark = F.regexp_extract(text, rf"(?s)^.*[{opens}]([^{opens}{closes}]*)$", 1)
    after_lead = F.regexp_extract(text, rf"(?s)^.*(?:{extract.PATTERNS["lead"]})([^{opens}{closes}]*)$", 1)
    marked = by_mark != ""
    cited = squeeze(F.when(marked, after_mark).otherwise(after_lead))
    closer = F.element_at(F.create_map(*[F.lit(x) for pair in CLOSERS.items() for x in pair]), F.when(marked, by_mark))
    return F.when(cited != "", F.struct(cited.alias("cited"), F.when(marked, by_mark).alias("open"), closer.alias("close")))


def insertions(chosen: DataFrame, passages: DataFrame, profile: Profile, scope: str = "whole", as_number: bool = False, before: bool = False) -> DataFrame:
    """The text that replaces what was typed. chosen: cand_id, group_id, ord, typed, typed_words, end_phrase, to_ord, open, close.

    typed (the text itself) is only read for the typed portion, which are the words of the passage that it agrees with longest; without that
    column, or where none agree, as many words from the passage's first as were typed.

    Adds last, body and inserted (null where the scope can't be met: no such phrase or passage, or more than WORD_CAP words).
    """
    if scope not in SCOPES:
        raise ValueError(scope)
    own = passages.select("group_id", "ord", "group_name", "text", "t1_words", "display_words")
    rows = chosen.join(canon_side(own, passages), ["group_id", "ord"])
    words = F.coalesce("display_words", F.split("text", " "))
    if scope in ("multiAyahs", "surahEnd"):
        to = F.lit(0) if scope == "surahEnd" else F.col("to_ord")
        ranges = rows.select("group_id", F.col("ord").alias("from_ord"), to.alias("to_ord")).distinct()
        texts = passages_of_range(ranges, passages).select("group_id", F.col("from_ord").alias("ord"), F.col("to_ord").alias("_to"), "last", F.array_join("texts", " ").alias("body"))
        rows = rows.withColumn("_to", to).join(texts, ["group_id", "ord", "_to"], "left").drop("_to")
    else:
        first, count = F.lit(1), F.size(words)
        said = lambda c: profile.words(profile.form(F.col(c)))
        if scope == "typedPortion":
            count = F.least(F.col("typed_words"), F.size(words))
            if "typed" in chosen.columns:
                rows = rows.withColumn("_run", align.longest_run(profile.drift)("t1_words", said("typed")))
                first, count = F.coalesce(F.col("_run.start") + 1, first), F.coalesce("_run.length", count)
        elif scope == "startToEndWord":
            rows = rows.withColumn("_end", align.phrase_end(profile.drift)("t1_words", said("end_phrase")))
            count = F.col("_end")
        body = F.col("text") if scope == "whole" else F.array_join(F.slice(words, first, F.greatest(count, F.lit(1))), " ")
        rows = rows.withColumn("last", F.col("ord")).withColumn("body", F.when(count.isNotNull(), body))
    fits = F.size(F.split("body", " ")) <= WORD_CAP
    name = F.col("group_id").cast("string") if as_number else F.col("group_name")
    quoted = F.concat(F.coalesce("open", F.lit("{")), F.col("body"), F.coalesce("close", F.lit("}")))
    ref = reference_text(name, F.col("ord"), F.col("last"))
    inserted = F.concat_ws(" ", ref, quoted) if before else F.concat_ws(" ", quoted, ref)
    return rows.select(*chosen.columns, "last", F.when(fits, F.col("body")).alias("body"), F.when(fits, inserted).alias("inserted"))
