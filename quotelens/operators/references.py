"""References: from the text of a citation to the passages that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.profiles import Profile, ascii_digits
from quotelens.functions.windows import if_small

#: The gap up to which "a, b" may also mean "a to b".
SMALL_GAP = 10


# Words before the name of a group and before its numbers, and the marks between numbers.
GROUP_WORDS, NUMBER_WORDS = "سورة|سوره", "الآيات|الآية"
DASHES, COMMAS = "-–—", "،,"
_OUTER = r"[^\p{L}\p{N}]*"


def parsed(ref: Column) -> Column:
    """name, ords, is_range and range_ords of a reference; null where it has no colon or no number."""
    # what stands between the first letter and the last letter or digit, cut at the first colon
    name = F.trim(F.regexp_replace(F.regexp_extract(ref, rf"^{_OUTER}([^:：]*)[:：]", 1), rf"^(?:من\s+)?(?:{GROUP_WORDS})\s+", ""))
    numbers = ascii_digits(F.regexp_extract(ref, rf"^[^:：]*[:：]\s*(?:(?:{NUMBER_WORDS})\s*)?(.*?){_OUTER}$", 1))
    parts = F.transform(F.split(numbers, f"[{COMMAS}]"), lambda p: F.trim(p))
    ends = F.split(numbers, rf"\s*[{DASHES}]\s*")
    is_span = numbers.rlike(rf"^\d+\s*[{DASHES}]\s*\d+$")
    low, high = (F.when(is_span, F.get(ends, F.lit(k))).try_cast("int") for k in (0, 1))
    span = F.when((low > 0) & (high >= low), F.sequence(low, high))
    listed = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"^\d+", 0).try_cast("int")), lambda n: n > 0)
    ords = F.when(is_span, span).otherwise(listed)
    two = (F.size(ords) == 2) & ~is_span
    a, b = F.try_element_at(ords, F.lit(1)), F.try_element_at(ords, F.lit(2))
    wider = F.when(two & (b > a) & (b - a <= SMALL_GAP), F.sequence(a, F.greatest(a, b)))
    several = F.when(is_span, span.isNotNull()).otherwise(F.size(parts) > 1)
    return F.when(ref.rlike(r"[:：]") & (F.size(ords) > 0), F.struct(name.alias("name"), ords.alias("ords"), several.alias("is_range"), wider.alias("range_ords")))


def resolved(citations: DataFrame, names: DataFrame, profile: Profile, ref: str = "ref") -> DataFrame:
    """Adds claimed_group, ords, is_range and range_ords; all null where the reference can't be read or names no group."""
    out = citations.withColumn("_p", parsed(F.col(ref))).withColumn("_name", profile.form(F.col("_p.name"))).withColumn("_skeleton", profile.skeleton(F.col("_name")))
    by = lambda column, group: if_small(names.select(F.col("name_key").alias(column), F.col("group_id").alias(group)), 100_000)
    out = out.join(by("_name", "_g1"), "_name", "left").join(by("_skeleton", "_g2"), "_skeleton", "left").withColumn("claimed_group", F.coalesce("_g1", "_g2"))
    known = F.col("claimed_group").isNotNull()
    return out.select(*citations.columns, "claimed_group", *[F.when(known, F.col(f"_p.{c}")).alias(c) for c in ("ords", "is_range", "range_ords")])


def passages_of_range(ranges: DataFrame, passages: DataFrame) -> DataFrame:
    """ranges: group_id, from_ord, to_ord (0 or less: to the end). Adds last (clamped to the group) and texts, in order."""
    sizes = passages.groupBy("group_id").agg(F.max("ord").alias("_end"))
    clamped = ranges.join(if_small(sizes, 100_000), "group_id").withColumn("last", F.when(F.col("to_ord") <= 0, F.col("_end")).otherwise(F.least("to_ord", "_end")))
    each = clamped.where("from_ord <= last").withColumn("ord", F.explode(F.sequence("from_ord", F.greatest("from_ord", "last"))))
    found = each.join(passages.select("group_id", "ord", "text"), ["group_id", "ord"]).groupBy(*ranges.columns, "last").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return found.select(*ranges.columns, "last", F.transform("p", lambda x: x["text"]).alias("texts"))
