"""Changing pages as streams: debounce, relevance, rates, and state that outlives a batch. All work on batch frames too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, LATE = "500 milliseconds", "10 minutes"
RATE, RATE_WINDOW = 8, 5
STUCK, FIRST_WAIT, LONGEST_WAIT = 5, 5, 15
FORGET_MS = 600_000


def rescans(changes: DataFrame, relevant: Column, keys: list[str], quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """changes: keys, ts. One row for each burst of changes that a quiet time ends, if any of them was relevant."""
    bursts = changes.withColumn("_relevant", relevant).withWatermark("ts", late).groupBy(*keys, F.session_window("ts", quiet).alias("s"))
    found = bursts.agg(F.count("*").alias("n_changes"), F.max(F.col("_relevant").cast("int")).alias("_any")).where("_any = 1")
    return found.select(*keys, F.col("s.start").alias("first_at"), F.col("s.end").alias("due_at"), "n_changes")


def too_fast(scans: DataFrame, keys: list[str], most: int = RATE, seconds: int = RATE_WINDOW) -> DataFrame:
    """Batch form: scans that are more than most within the last seconds of their key, with in_window.

    A key's scans are taken in spans of that many seconds, each with those of the span before, so no task holds all scans of a key.
    """
    at = F.unix_micros("ts")
    span = F.floor(at / (seconds * 1_000_000))
    near = scans.withColumn("_own", span).withColumn("_span", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    counted = near.withColumn("in_window", F.count("*").over(w)).where("_own = _span or _own is null")
    return counted.where(F.col("in_window") > most).drop("_own", "_span")


def streaks(scans: DataFrame, keys: list[str], order: list[str], signature: str, part: Column | None = None) -> DataFrame:
    """Batch form: adds streak, how many scans of the key in a row had this signature so far.

    part: what cuts the scans of a key into parts that follow one another in order (the day of a time that they are ordered by). Each
    part is counted by itself, and the streak at its end is carried to the next one, so no task holds all scans of a key.
    """
    placed = scans.withColumn("_part", F.lit(0) if part is None else part)
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = F.col(signature).eqNullSafe(F.lag(signature).over(w)) & (F.row_number().over(w) > 1)
    placed = placed.withColumn("_island", F.sum((~same).cast("int")).over(w))
    placed = placed.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_part", "_island").orderBy(*order)))
    if part is None:
        return placed.drop("_part", "_island")
    names = [f"_{k}" for k in keys]
    last = F.struct("_island", "streak", signature)
    ends = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_p")).agg(F.max(last).alias("_last"))
    ends = ends.select(*names, "_p", F.col("_last._island").alias("_islands"), F.col("_last.streak").alias("_streak"), F.col(f"_last.{signature}").alias("_sign"))
    # a part of one signature goes on with that of the part before; the streak at its end is the sum of such parts
    along = Window.partitionBy(*names).orderBy("_p")
    goes_on = (F.col("_islands") == 1) & F.col("_sign").eqNullSafe(F.lag("_sign").over(along)) & (F.row_number().over(along) > 1)
    ends = ends.withColumn("_chain", F.sum((~goes_on).cast("int")).over(along))
    ends = ends.withColumn("_whole", F.sum("_streak").over(Window.partitionBy(*names, "_chain").orderBy("_p")))
    before = ends.select(*names, "_p", F.lag("_whole").over(along).alias("_carried"), F.lag("_sign").over(along).alias("_before"))
    joined = F.col("_part").eqNullSafe(F.col("_p"))
    for k, n in zip(keys, names, strict=True):
        joined &= F.col(k).eqNullSafe(F.col(n))
    out = placed.join(before, joined, "left")
    more = F.when((F.col("_island") == 1) & F.col(signature).eqNullSafe(F.col("_before")), F.coalesce("_carried", F.lit(0))).otherwise(0)
    return out.withColumn("streak", (F.col("streak") + more).cast("int")).select(*scans.columns, "streak")


def wait_after(failures: Column) -> Column:
    """Seconds to wait after so many pauses without progress in a row."""
    return F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))), F.lit(LONGEST_WAIT)).cast("int")


def breaker(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one page: recent scans, last signature, its streak, pauses. A row for each scan: may it run, and until when not."""
    if state.hasTimedOut:
        state.remove()
        return
    recent, last, streak, pauses, until = state.get if state.exists else ([], None, 0, 0, 0.0)
    recent, out = list(recent), []
    for row in pd.concat(list(frames)).sort_values("ts").itertuples():
        now = row.ts.timestamp()
        streak = streak + 1 if row.signature == last else 1
        pauses, last = (0, row.signature) if row.signature != last else (pauses, last)
        recent = [t for t in recent if now - t < RATE_WINDOW] + [now]
        if now >= until and (len(recent) > RATE or streak >= STUCK):
            pauses += 1
            until = now + min(FIRST_WAIT * 2 ** (pauses - 1), LONGEST_WAIT)
            streak = 0
        out.append((*key, row.ts, now >= until, pauses))
    state.update((recent, last, streak, pauses, until))
    # forgotten when its last scan and pause are long past in event time
    state.setTimeoutTimestamp(int(max(max(recent, default=0), until) * 1000) + FORGET_MS)
    yield pd.DataFrame(out, columns=["page_id", "ts", "runs", "pauses"])


def guarded(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Stream of page_id (string), ts, signature (string): page_id, ts, runs and pauses, by the rate and progress of each page.

    Within a micro-batch scans are taken in order of ts; one that comes in a later batch than its successors counts as it comes. A page's state
    goes when the watermark has passed its last scan by FORGET_MS.
    """
    return scans.withWatermark("ts", late).groupBy("page_id").applyInPandasWithState(breaker, "page_id string, ts timestamp, runs boolean, pauses int", "recent array<double>, last string, streak int, pauses int, until double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, keys: list[str], width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events of each key in tumbling windows, or sliding ones: keys, from, to and n. In a stream a window comes when the watermark has passed it."""
    counted = events.withWatermark("ts", late).groupBy(*keys, F.window("ts", width, slide or width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def latest_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Of the requests of a micro-batch (keys, ts, token) the last of each key: earlier ones are stale before they are answered."""
    newest = requests.groupBy(*keys).agg(F.max(F.struct("ts", "token")).alias("_last"))
    return requests.join(newest, keys).where(F.struct("ts", "token") == F.col("_last")).drop("_last").dropDuplicates([*keys, "ts", "token"])


def to_scan_in_full(before: DataFrame, after: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages of which a part was scanned again with a result that part alone can't be trusted for: a finding (page, id, verdict) that is new or has another verdict, and isn't green."""
    doubtful = after.where(~F.col("verdict").isin("green", "lightGreen"))
    return doubtful.join(before.select(page, "id", "verdict"), [page, "id", "verdict"], "left_anti").select(page).distinct()


def first_seen(findings: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Stream of findings without those seen before within the watermark."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def common_root(changed: DataFrame, keys: list[str], path: str, separator: str = "/", hops: int = 5) -> DataFrame:
    """The part that all changed paths of a key share, if it is at most so many steps above the shortest; else null.

    All paths between the smallest and the largest share what these two share.
    """
    ends = changed.groupBy(*keys).agg(F.min(F.split(path, separator)).alias("_a"), F.max(F.split(path, separator)).alias("_b"), F.min(F.size(F.split(path, separator))).alias("_n"))
    same = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a == b) & a.isNotNull() & b.isNotNull()), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])
    shared = ends.withColumn("_shared", F.coalesce(same, F.lit(0)))
    return shared.select(*keys, F.when((F.col("_shared") > 0) & (F.col("_n") - F.col("_shared") <= hops), F.array_join(F.slice("_a", 1, F.col("_shared")), separator)).alias("root"))
