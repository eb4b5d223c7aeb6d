"""Mixing sources to target weights along a time-varying curriculum.

Training runs over t from 0 to 1. A source with target T and slope a has the weight schedule ``T * (1 + a * (2t - 1))``,
whose integral ``T * (t + a * (t*t - t))`` is the number of its words needed until t and ends at T. The words of a source
are laid out one after another, and once more if its target needs them again; inverting the integral at the words before a
document gives the document's training position in each pass, and sorting all of them by range of position gives the
order of training. So the words of a source that have come until any t are those its schedule asks for, but for one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights and slopes of the sources in order of code point, repeated as needed.
WEIGHTS, SLOPES = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5)
#: Words to share out, as a part of all there are, and the times that a source's words may be used.
BUDGET, MOST = 1.5, 2
#: Hex digits of the hash of a row by which a source is cut into parts for running sums.
PART_DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sizes: _source (null last), source_size. Adds weight, slope and target, one row a source.

    Targets share budget times all sizes by weight; none exceeds most times its source's size, and what would be above is
    shared again by weight. Sources reach that limit in order of limit / weight, so one running sum over the sources
    finds how many do. The sources, not their rows, meet in one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(values))) + 1).cast("int"))
    named = sizes.withColumn("weight", cycle(weights)).withColumn("slope", cycle(slopes)).withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        named.withColumn("_full", F.coalesce(F.sum("_limit").over(by_ratio), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("_share", (F.lit(budget) * F.sum("source_size").over(everything) - F.col("_full")) / F.col("_rest"))
    )
    # the first source in order of limit / weight whose limit isn't reached fixes the share of one unit of weight
    share = F.min(F.when(F.col("_share") * F.col("weight") < F.col("_limit"), F.struct((F.col("_limit") / F.col("weight")).alias("ratio"), F.col("_share").alias("share")))).over(everything)["share"]
    target = F.least(F.col("_limit"), F.coalesce(share * F.col("weight"), F.col("_limit")))
    return summed.withColumn("target", target).select("_source", "source_size", "weight", "slope", "target")


def position_at(words: Column, target: Column, slope: Column) -> Column:
    """The t at which a source of that target and slope has needed that many words."""
    x, b = F.try_divide(words, target), F.lit(1.0) - slope
    return F.when(slope == 0, x).otherwise(F.try_divide(F.sqrt(b * b + F.lit(4.0) * slope * x) - b, F.lit(2.0) * slope))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", text: str = "text", **shares) -> DataFrame:
    """What the mix takes of every row: row (a struct of all columns of docs), size, source_size, target, taken, position, again and position_again.

    The rows of a source are laid out in order of a hash of key and text, so rows of one key are spread, and only equal ones are interchangeable; the target's words are taken from the front, once
    more from the front if it is larger than the source, so the last row may be taken in part. taken counts the words of both passes,
    again those of the second one; position and position_again are where they come, null where nothing is
    taken. A null key or source is a value like others; rows of size 0 take nothing; an empty table gives one.
    Running sums are made within parts of a source, and over the sums of parts, so no task holds a whole source.
    """
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    columns = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("size"), order.alias("_order")]
    rows = docs.select(*columns).withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    parts = rows.groupBy("_source", "_part").agg(F.sum("size").alias("_words"))
    targets = source_targets(parts.groupBy("_source").agg(F.sum("_words").alias("source_size")), **shares)
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("_first", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    firsts = firsts.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_words")
    within = Window.partitionBy("_source", "_part").orderBy("_order", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    firsts = firsts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "_first", "source_size", "slope", "target")
    laid = laid.join(firsts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    start, want = F.col("_first") + F.col("_within"), F.round("target").cast("long")
    once = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), want - at)).cast("long")
    next_start = start + F.col("source_size")
    at = lambda words, n: F.when(F.col(n) > 0, position_at(words, F.col("target"), F.col("slope")))
    laid = laid.withColumn("again", once(next_start)).withColumn("taken", once(start) + F.col("again"))
    return laid.withColumn("position", at(start, "taken")).withColumn("position_again", at(next_start, "again")).select("row", "size", "source_size", "target", "taken", "position", "again", "position_again")


def passes(mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row and position of every use of a document, in order of training; a row's text is cut to the words that are taken.

    A range sort: parts of the output follow one another in training. Documents that aren't taken have no use.
    """
    first = F.struct(F.col("position"), (F.col("taken") - F.col("again")).alias("words"))
    uses = F.explode(F.filter(F.array(first, F.struct(F.col("position_again").alias("position"), F.col("again").alias("words"))), lambda u: u["words"] > 0))
    used = mixed.select("row", "size", uses.alias("use"))
    cut = F.when(F.col("use.words") < F.col("size"), first_words(F.col(f"row.{text}"), F.col("use.words"))).otherwise(F.col(f"row.{text}"))
    return used.select(F.col("row").withField(text, cut).alias("row"), F.col("use.position").alias("position")).orderBy("position", f"row.{key}")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")
