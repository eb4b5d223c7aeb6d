"""Timers, two phases that survive a failure between them, and joined streams."""

import pytest
from pyspark.sql import functions as F
from test_streaming import at, run, stream_of

from quotelens.streaming import stateful

SCHEMA = "page_id string, url string, ts timestamp, signature string, finding string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.STORE)
    yield spark
    spark.conf.set(name, before)


def test_pauses_end_by_timers_and_routes_begin_anew(rocks, tmp_path):
    stuck = [("p", "u", at(1000 * i), "same", "f1") for i in range(5)]  # the fifth pauses: 4 s + 5 s
    other = [("p", "v", at(4000), "same", "f1")]  # another url of the page: not paused, and its findings are new
    later = [("q", "u", at(2_000_000 + i), "x", None) for i in range(2)]
    gone = [("p", "u", at(9_000_000), "same", "f1")]
    end = [("q", "u", at(20_000_000), "x", None)]
    got = run(stateful.guarded_pages(stream_of(rocks, [stuck, other, later, later, gone, end, end], SCHEMA, tmp_path)), "guards", tmp_path)
    p = sorted(((r.ts, r.event, r.finding, r.pauses) for r in got if (r.page_id, r.url) == ("p", "u")), key=lambda r: r[0])
    assert [e for _, e, _, _ in p[:5]] == ["scan"] * 4 + ["paused"] and [f for _, _, f, _ in p[:5]] == ["f1"] + [None] * 4
    assert p[5][:2] == (at(9000), "resumed")  # without a scan of its own
    assert "forgotten" in [e for _, e, _, _ in p[6:]]
    back = [r for r in p if r[0] == at(9_000_000)]
    assert [(e, f) for _, e, f, _ in back] == [("scan", "f1")]  # nothing is left of before
    assert [(r.event, r.finding) for r in got if r.url == "v" and r.event == "scan"] == [("scan", "f1")]


def test_too_fast(rocks, tmp_path):
    fast = [("p", "u", at(100 * i), str(i), None) for i in range(10)]
    got = run(stateful.guarded_pages(stream_of(rocks, [fast], SCHEMA, tmp_path)), "fast", tmp_path)
    assert [r.event for r in sorted(got, key=lambda r: r.ts)] == ["scan"] * 8 + ["paused"] * 2


PARTS = "page_id string, id string, verdict string, kind string, payload string, at timestamp"


def test_two_phases_and_a_failure_between(spark, tmp_path, monkeypatch):
    batches = [
        [("a", "1", "green", None, None, None), ("b", "1", "red", None, None, None)],
        [("a", "2", "green", None, None, None), ("b", "1", "red", "ref-edit", "x", at(0)), ("a", "1", "green", "text-replace", "y", at(0))],
        [("c", "1", "orange", None, None, None), ("a", "1", "green", "revert", None, at(5))],
    ]
    every = spark.createDataFrame([("b", "1", "red"), ("b", "9", "yellow"), ("c", "1", "orange"), ("c", "2", "green"), ("a", "7", "red")], "page_id string, id string, verdict string")
    asked, folder = [], f"file://{tmp_path}/out"

    def whole(pages):
        asked.append(sorted(r.page_id for r in pages.collect()))
        return every.join(pages, "page_id", "left_semi")

    stream = stream_of(spark, batches, PARTS, tmp_path)

    def go(fail_at=None):
        phases = stateful.two_phase(spark, folder, whole, lambda: F.lit(at(10)))
        put = stateful.corrections.upserted

        def upserted(*args):
            if fail_at is not None and stateful.version(spark, folder, "findings", 1 << 62) == fail_at:
                raise RuntimeError("lost between the phases")
            return put(*args)

        monkeypatch.setattr(stateful.corrections, "upserted", upserted)
        q = stream.writeStream.foreachBatch(phases).option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
            monkeypatch.setattr(stateful.corrections, "upserted", put)

    with pytest.raises(Exception):
        go(fail_at=1)
    assert stateful.version(spark, folder, "findings", 1 << 62) == 1 and stateful.version(spark, folder, "corrections", 1 << 62) == 0
    go()
    found = {tuple(r) for r in stateful.latest(spark, folder, "findings").collect()}
    assert found == {("a", "1", "green"), ("a", "2", "green"), ("b", "1", "red"), ("b", "9", "yellow"), ("c", "1", "orange"), ("c", "2", "green")}
    kept = {(r.url_key, r.composite_key, r.kind, r.payload) for r in stateful.latest(spark, folder, "corrections").collect()}
    assert kept == {("b", "1", "ref-edit", "x")}
    # the batch that failed after its first phase isn't scanned again
    assert asked == [["b"], [], ["c"]]


def test_joined_streams_equal_the_batch(spark, tmp_path):
    f = [[("p", "1", at(0), "red"), ("p", "2", at(0), "red")], [("p", "3", at(1000), "orange")], [("z", "1", at(8_000_000), "red")], [("z", "1", at(8_000_000), "red")], [("z", "2", at(16_000_000), "red")]]
    c = [[("p", "1", at(10_000), "ref-edit")], [("p", "1", at(20_000), "text-replace"), ("p", "2", at(7_200_000), "ref-edit")], [("z", "9", at(8_000_000), "x")], [("z", "9", at(8_000_000), "x")], [("p", "3", at(2000), "too late"), ("z", "9", at(16_000_000), "x")]]
    found, kept = "page_id string, id string, ts timestamp, verdict string", "page_id string, id string, at timestamp, kind string"
    (tmp_path / "f").mkdir(), (tmp_path / "c2").mkdir()
    joined = stateful.with_corrections(stream_of(spark, f, found, tmp_path / "f"), stream_of(spark, c, kept, tmp_path / "c2"))
    got = {(r.page_id, r.id, r.kind) for r in run(joined, "joined", tmp_path)}
    rows = lambda parts, schema: spark.createDataFrame([r for part in parts for r in part], schema)
    batch = {(r.page_id, r.id, r.kind) for r in stateful.with_corrections(rows(f, found), rows(c, kept)).collect()}
    assert {("p", "1", "ref-edit"), ("p", "1", "text-replace"), ("p", "2", None), ("p", "3", "too late")} <= batch
    # the row that comes after the watermark isn't joined; what is still open hasn't come
    assert got == (batch - {("p", "3", "too late")} | {("p", "3", None)}) - {r for r in batch if r[0] == "z" and r[1] == "2"}
