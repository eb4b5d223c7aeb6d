"""Streams that act by themselves: pages that pause and go on by timers, scans in two phases, findings joined with corrections.

    guarded_pages        a page's rate and progress as typed state with timers; one key for each page and url
    two_phase            each micro-batch's partial scans, promoted to whole ones where they can't be trusted, and corrections
    with_corrections     findings joined with the corrections made for them within a time
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quotelens.operators import corrections
from quotelens.store import delete, move
from quotelens.streaming.changes import FIRST_WAIT, LATE, LONGEST_WAIT, RATE, RATE_WINDOW, STUCK, to_scan_in_full

#: The provider that keeps lists, maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_MS = 600_000


class PageGuard(StatefulProcessor):
    """One page at one url: its recent scans (list), last signature with streak, pauses and the end of a pause (values), and the findings it has reported (map, which forgets).

    More than RATE scans in RATE_WINDOW seconds, or STUCK equal signatures in a row, pause the page: 5 seconds, then 10,
    then 15, until there is progress. A pause ends by a timer that says so, without a new scan. A page that goes on to another
    url has another key, so it begins anew; a page that isn't seen for FORGET_MS is forgotten by a timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at double")
        self.progress = handle.getValueState("progress", "signature string, streak int, pauses int, until double")
        self.reported = handle.getMapState("reported", "id string", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signature, streak, pauses, until = self.progress.get() if self.progress.exists() else (None, 0, 0, 0.0)
        recent = [t for (t,) in self.recent.get()]
        out, now = [], 0.0
        for row in pd.concat(list(rows)).sort_values("ts").itertuples():
            now = row.ts.timestamp()
            if recent and now - max(recent) >= FORGET_MS / 1000 and now >= until:
                # as good as forgotten, though its timer comes after the rows of this batch
                signature, streak, pauses, until, recent = None, 0, 0, 0.0, []
                self.reported.clear()
            streak = streak + 1 if row.signature == signature else 1
            pauses, signature = (0, row.signature) if streak == 1 else (pauses, signature)
            recent = [t for t in recent if now - t < RATE_WINDOW] + [now]
            if now >= until and (len(recent) > RATE or streak >= STUCK):
                pauses += 1
                until, streak = now + min(FIRST_WAIT * 2 ** (pauses - 1), LONGEST_WAIT), 0
                self.handle.registerTimer(int(until * 1000))
            runs = now >= until
            fresh = runs and row.finding is not None and not self.reported.containsKey((row.finding,))
            if fresh:
                self.reported.updateValue((row.finding,), (now,))
            out.append((*key, row.ts, "scan" if runs else "paused", row.finding if fresh else None, pauses))
        self.progress.update((signature, streak, pauses, until))
        self.recent.put([(t,) for t in recent])
        self._forget_later(now)
        yield pd.DataFrame(out, columns=["page_id", "url", "ts", "event", "finding", "pauses"])

    def _forget_later(self, now: float) -> None:
        # one timer for a span of time, so a busy page has few
        self.handle.registerTimer(int(now * 1000) // FORGET_MS * FORGET_MS + 2 * FORGET_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        signature, streak, pauses, until = self.progress.get() if self.progress.exists() else (None, 0, 0, 0.0)
        last = max((t for (t,) in self.recent.get()), default=0.0)
        event = None
        if int(until * 1000) == at:
            event = "resumed"
        elif at - last * 1000 >= FORGET_MS and at >= until * 1000:
            for state in (self.recent, self.progress, self.reported):
                state.clear()
            event = "forgotten"
        rows = [(*key, pd.Timestamp(at, unit="ms"), event, None, pauses)] if event else []
        yield pd.DataFrame(rows, columns=["page_id", "url", "ts", "event", "finding", "pauses"])

    def close(self) -> None:
        pass


def guarded_pages(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Stream of page_id, url, ts, signature and finding (strings; a finding may be null): page_id, url, ts, event, finding and pauses.

    event: scan (with finding, if the page hasn't reported it before), paused (the scan doesn't count), resumed and forgotten (by timers,
    when the watermark passes them). The session's state store has to be STORE.
    """
    keyed = scans.withWatermark("ts", late).groupBy("page_id", "url")
    return keyed.transformWithStateInPandas(PageGuard(), "page_id string, url string, ts timestamp, event string, finding string, pauses int", "append", "eventTime")


Scan = Callable[[DataFrame], DataFrame]


def two_phase(spark: SparkSession, folder: str, whole: Scan, now: Callable[[], object] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over partial scans: page_id, id, verdict, and for corrections kind, payload and at (kind null: none).

    First phase: pages of which a part has a new or changed finding that isn't green are scanned as a whole (whole: page_id ->
    page_id, id, verdict), and their findings replace those in folder/findings; of other pages the partial ones are put in. Second phase: the
    batch's corrections are put into folder/corrections. Either table is written beside, under the number of the batch, and becomes the
    current one by its name alone; a batch that comes again after a failure finds what it has done already, so it is done once.
    """
    columns = {"findings": "page_id string, id string, verdict string", "corrections": "url_key string, composite_key string, kind string, at timestamp, payload string"}

    def current(table: str, before: int) -> DataFrame:
        last = version(spark, folder, table, before)
        return spark.read.schema(columns[table]).parquet(f"{folder}/{table}/{last:020d}") if last is not None else spark.createDataFrame([], columns[table])

    def put(table: str, batch: int, df: DataFrame) -> None:
        draft, place = f"{folder}/drafts/{table}-{batch:020d}", f"{folder}/{table}/{batch:020d}"
        df.write.mode("overwrite").parquet(draft)
        if not move(spark, draft, place):
            delete(spark, draft)

    def done(table: str, batch: int) -> bool:
        return version(spark, folder, table, batch + 1) == batch

    def phases(partial: DataFrame, batch: int) -> None:
        if not done("findings", batch):
            known = current("findings", batch)
            new = partial.where("id is not null").select("page_id", "id", "verdict").dropDuplicates(["page_id", "id"])
            promoted = to_scan_in_full(known, new)
            scanned = whole(promoted)
            kept = known.join(promoted, "page_id", "left_anti").join(new.select("page_id", "id"), ["page_id", "id"], "left_anti")
            put("findings", batch, kept.unionByName(new.join(promoted, "page_id", "left_anti")).unionByName(scanned.select("page_id", "id", "verdict")))
        if not done("corrections", batch):
            changed = partial.where("kind is not null").select(F.col("page_id").alias("url_key"), F.col("id").alias("composite_key"), "kind", "at", "payload")
            undone = changed.where("kind = 'revert'").select("url_key", "composite_key").distinct()
            rest = corrections.upserted(current("corrections", batch), changed.where("kind <> 'revert'"), now())
            put("corrections", batch, rest.join(undone, ["url_key", "composite_key"], "left_anti"))

    return phases


def version(spark: SparkSession, folder: str, table: str, before: int) -> int | None:
    """The last batch, before that number, that has written a table of two_phase; None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    numbers = [int(s.getPath().getName()) for s in files.listStatus(where)]
    return max((n for n in numbers if n < before), default=None)


def latest(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The current findings or corrections of two_phase, or None before its first batch."""
    last = version(spark, folder, table, 1 << 62)
    return spark.read.parquet(f"{folder}/{table}/{last:020d}") if last is not None else None


def with_corrections(found: DataFrame, changes: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Findings (page_id, id, ts, verdict) with each correction (page_id, id, at, kind) made for them at most so long after: page_id, id, ts, verdict, kind and at.

    A finding without one comes with nulls, in a stream when the watermark has passed the time for it; both sides forget by
    watermark. Rows later than late are not joined. The same on batch frames.
    """
    a = found.select("page_id", "id", "ts", "verdict").withWatermark("ts", late)
    b = changes.select(F.col("page_id").alias("_page"), F.col("id").alias("_id"), "at", "kind").withWatermark("at", late)
    soon = F.expr(f"page_id = _page and id = _id and at >= ts and at <= ts + interval {within}")
    return a.join(b, soon, "left_outer").select("page_id", "id", "ts", "verdict", "kind", "at")
