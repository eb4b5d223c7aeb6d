"""Where in a page the reference of a quotation is written, whatever invisible marks lie in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.labels import strip_invisible
from quotelens.functions.profiles import INVISIBLE

#: Characters after a quotation in which its reference begins.
REACH = 400


def kept_places(text: Column) -> Column:
    """The places (from 0) of a text's characters that stay when invisible ones go: the k-th is that of the stripped text's k-th character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    places = F.transform(chars, lambda c, i: F.when(~F.rlike(c, F.lit(INVISIBLE)), i))
    return F.filter(places, lambda p: p.isNotNull())


def original_span(places: Column, start: Column, end: Column) -> Column:
    """A span (start, end) of a stripped text as one of the text itself: from its first character to its last one; places: kept_places of the text."""
    return F.struct(F.try_element_at(places, (start + 1).cast("int")).alias("start"), (F.try_element_at(places, F.greatest(end, F.lit(1)).cast("int")) + 1).alias("end"))


def ref_marks(found: DataFrame, texts: DataFrame, key: str = "page_id", reach: int = REACH) -> DataFrame:
    """found (key, end, ref, as scan() gives them) with mark: the start and end of the first place after the quotation where its reference is written; null if it is in none within reach, or there is no reference.

    texts: key and text (the page's joined text). A reference as it is written goes before one with invisible marks in it, or in the page.
    """
    window = F.substring("_page", (F.col("end") + 1).cast("int"), F.length("ref") + reach)
    rows = found.join(texts.select(F.col(key).alias("_key"), F.col("text").alias("_page")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("_window", window)
    plain = F.instr(F.col("_window"), F.col("ref")) - 1
    bare = strip_invisible(F.col("ref"))
    places = kept_places(F.col("_window"))
    at = F.instr(strip_invisible(F.col("_window")), bare) - 1
    inside = original_span(places, at, at + F.length(bare))
    local = F.when(plain >= 0, F.struct(plain.alias("start"), (plain + F.length("ref")).alias("end"))).when((at >= 0) & (F.length(bare) > 0), inside)
    mark = F.when((F.length("ref") > 0) & local.isNotNull() & (local["start"] <= reach), F.struct((F.col("end") + local["start"]).cast("int").alias("start"), (F.col("end") + local["end"]).cast("int").alias("end")))
    return rows.withColumn("mark", mark).drop("_page", "_window")
