"""Findings: identity, duplicates, limits, and reports on them. A finding has page_id, seq (its place), id, verdict and refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.labels import severity

CAP = 500
VERDICTS = ("green", "lightBlue", "yellow", "orange", "red")


def latest(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by order."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def occurrence(findings: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds occurrence: how many rows of equal keys come before."""
    return findings.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1)


def first_per_page(findings: DataFrame, page: str, order: list[str], cap: int = CAP) -> DataFrame:
    """The first cap findings of each page. Spark cuts each task's rows of a page to cap before it shuffles them, so a page of very many is no burden."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def verdict_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A count of each verdict, all of them, the final state and the highest severity for each key."""
    each = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in VERDICTS]
    bad = F.bool_or(F.col("verdict").isin("yellow", "orange", "red"))
    worst = F.coalesce(F.max(severity(F.col("verdict"))), F.lit(0))
    total = F.count("verdict")
    return findings.groupBy(*keys).agg(*each, total.alias("n_total"), F.when(total == 0, "empty").when(bad, "defects").otherwise("clean").alias("state"), worst.alias("severity"))


def strategy_counts(found: DataFrame) -> DataFrame:
    """How many candidates each rule gave."""
    return found.groupBy("strategy").agg(F.count("*").alias("n"))


def scan_events(found: DataFrame, pages: DataFrame, page: str = "page_id", seq: str = "seq", cap: int = CAP) -> DataFrame:
    """What a scan says of its progress: page, event and n. start and complete (with the number of findings) for every page, progress for each finding, cap_hit where there are as many as may be."""
    counted = pages.select(page).join(found.groupBy(page).agg(F.count("*").alias("n")), page, "left").select(page, F.coalesce("n", F.lit(0)).alias("n"))
    said = lambda df, event, n: df.select(page, F.lit(event).alias("event"), n.cast("long").alias("n"))
    events = (said(counted, "start", F.lit(0)), said(found, "progress", F.col(seq) + 1), said(counted.where(F.col("n") >= cap), "cap_hit", F.lit(cap)), said(counted, "complete", F.col("n")))
    return events[0].unionByName(events[1]).unionByName(events[2]).unionByName(events[3])


def checked(found: DataFrame) -> DataFrame:
    """found as it is; a verdict that there is none of, or a green one whose wording differs by words, raises an error."""
    known = F.col("verdict").isin(*VERDICTS)
    sound = (F.col("verdict") != "green") | F.col("deviation").isNull() | F.col("deviation").isin("none", "tashkeelOnly", "spellingDrift")
    return found.withColumn("verdict", F.when(known & sound, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no such finding: "), F.coalesce("verdict", F.lit("null"))))))


def badge(state: Column, severity_: Column) -> Column:
    return F.when(state == "empty", "-").when(severity_ == 3, "!").when(severity_ == 2, "~").when(severity_ == 1, "?").otherwise("ok")


def resolved_by_neighbours(findings: DataFrame, page: str = "page_id", order: str = "seq") -> DataFrame:
    """Adds resolved_group to findings with several candidate groups: the group of the resolved finding before, else after, if it is one of them.

    groups: the candidate groups; one alone is resolved as it is.
    """
    own = F.when(F.size("groups") == 1, F.element_at("groups", 1))
    w = Window.partitionBy(page).orderBy(order)
    before = F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_own", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = findings.withColumn("_own", own).withColumn("_b", before).withColumn("_a", after)
    chosen = F.coalesce(F.col("_own"), F.when(F.array_contains("groups", F.col("_b")), F.col("_b")), F.when(F.array_contains("groups", F.col("_a")), F.col("_a")))
    return near.withColumn("resolved_group", chosen).drop("_own", "_b", "_a")


def nearest_in_claimed_group(refs: Column, group: Column, ord_: Column) -> Column:
    """Of refs the one to correct a wrong reference with: the only one, or the only one of the claimed group, or there the strictly nearest."""
    mine = F.filter(refs, lambda r: r["group_id"] == group)
    ranked = F.array_sort(F.transform(mine, lambda r: F.struct(F.abs(r["ord"] - ord_).alias("away"), r["group_id"].alias("group_id"), r["ord"].alias("ord"))))
    one, two = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    near = F.when(one.isNotNull() & (two.isNull() | (one["away"] < two["away"])), F.struct(one["group_id"].alias("group_id"), one["ord"].alias("ord")))
    return F.when(F.size(refs) == 1, F.element_at(refs, 1)).otherwise(near)


def precision_recall(judged: DataFrame, verdict: str, expected: str) -> DataFrame:
    """For each verdict expected: how many were found, missed and wrongly given, precision and recall."""
    said, true = judged.select(F.col(verdict).alias("v"), (F.col(verdict) == F.col(expected)).cast("int").alias("hit"), F.lit(0).alias("want")), judged.select(F.col(expected).alias("v"), F.lit(0).alias("hit"), F.lit(1).alias("want"))
    n = said.withColumn("said", F.lit(1)).unionByName(true.withColumn("said", F.lit(0))).where("v is not null").groupBy("v")
    sums = n.agg(F.sum("hit").alias("tp"), (F.sum("said") - F.sum("hit")).alias("fp"), (F.sum("want") - F.sum("hit")).alias("fn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return sums.select(F.col("v").alias("verdict"), "tp", "fp", "fn", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"))


def share_record(findings: DataFrame) -> DataFrame:
    """A finding as one JSON text."""
    return findings.withColumn("record", F.to_json(F.struct(*sorted(findings.columns))))


def profile(judged: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """Count, sum, mean and maximum of a cost for each key."""
    return judged.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.max(cost).alias("most"))


def panel(findings: DataFrame, kept: DataFrame, keys: list[str], shown: tuple[str, ...] = VERDICTS) -> DataFrame:
    """The rows of a page's list in order: corrected in this visit, open, dismissed, corrected before; only colours shown.

    kept: keys, id, kind ("dismissal" or a correction), recent. A finding takes over what was kept for the one it replaced.
    """
    # numbered, so that equal findings stay apart
    rows = findings.where(F.col("verdict").isin(*shown)).withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array("id", "prior_id")))))
    state = kept.groupBy(*keys, F.col("id").alias("_key")).agg(F.bool_or(F.col("kind") == "dismissal").alias("_off"), F.bool_or((F.col("kind") != "dismissal") & F.col("recent")).alias("_new"), F.bool_or((F.col("kind") != "dismissal") & ~F.col("recent")).alias("_old"))
    joined = rows.join(state, [*keys, "_key"], "left").groupBy("_row", *findings.columns).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("_off", "_new", "_old")])
    section = F.when(F.col("_new"), 0).when(F.col("_off"), 2).when(F.col("_old"), 3).otherwise(1)
    return joined.withColumn("section", section).drop("_off", "_new", "_old", "_row").withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("section", "seq")))
