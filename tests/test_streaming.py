"""Streams give what the batch forms give; the breaker pauses pages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quotelens.streaming import changes

START = datetime(2024, 1, 1)


def at(ms):
    return START + timedelta(milliseconds=ms)


def stream_of(spark, rows, schema, tmp_path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_debounced_stream_equals_batch(spark, tmp_path):
    schema = "page_id string, ts timestamp, text string"
    rows = [[("p", at(0), "x"), ("p", at(300), "yes"), ("p", at(700), "x"), ("q", at(0), "x")], [("p", at(5000), "yes")], [("z", at(9_000_000), "yes")], [("z", at(20_000_000), "yes")]]
    stream = changes.rescans(stream_of(spark, rows, schema, tmp_path), F.col("text") == "yes", ["page_id"])
    got = {(r.page_id, r.first_at, r.n_changes) for r in run(stream, "bursts", tmp_path)}
    batch = spark.createDataFrame([r for part in rows for r in part], schema)
    want = {(r.page_id, r.first_at, r.n_changes) for r in changes.rescans(batch, F.col("text") == "yes", ["page_id"]).collect()}
    assert ("p", at(0), 3) in want and ("p", at(5000), 1) in want and not any(r[0] == "q" for r in want)
    assert got == {r for r in want if r[1] < at(20_000_000)}  # the watermark holds the last burst open


def test_breaker(spark, tmp_path):
    schema = "page_id string, ts timestamp, signature string"
    fast = [("fast", at(100 * i), str(i)) for i in range(10)]
    stuck = [("stuck", at(6000 * i), "same") for i in range(6)]
    calm = [("calm", at(6000 * i), str(i)) for i in range(6)]
    got = run(changes.guarded(stream_of(spark, [fast + stuck + calm], schema, tmp_path)), "guarded", tmp_path)
    runs = lambda p: [r.runs for r in sorted((r for r in got if r.page_id == p), key=lambda r: r.ts)]
    assert runs("calm") == [True] * 6 and runs("fast") == [True] * 8 + [False] * 2 and runs("stuck") == [True] * 4 + [False, True]


def test_first_seen(spark, tmp_path):
    schema = "id string, ts timestamp"
    stream = changes.first_seen(stream_of(spark, [[("a", at(0)), ("b", at(0))], [("a", at(1000)), ("c", at(1000))]], schema, tmp_path), ["id"])
    assert sorted(r.id for r in run(stream, "seen", tmp_path)) == ["a", "b", "c"]


def test_streaks_and_rates(spark):
    rows = [("p", at(1000 * i), s) for i, s in enumerate(["a", "a", None, None, "a"])]
    df = spark.createDataFrame(rows, "page_id string, ts timestamp, signature string")
    assert [r.streak for r in changes.streaks(df, ["page_id"], ["ts"], "signature").orderBy("ts").collect()] == [1, 2, 1, 2, 1]
    assert [r.in_window for r in changes.too_fast(df, ["page_id"], 2, 2).collect()] == [3, 3, 3]
    assert spark.range(1).select(*[changes.wait_after(F.lit(k)).alias(str(k)) for k in (1, 2, 3)]).first() == (5, 10, 15)


def test_streaks_in_parts_equal_whole_ones(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["p", "q", None]), at(1000 * i), rng.choice(["a", "a", "a", "b", None])) for i in range(300)] + [("r", at(1000 * i), "a") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id string, ts timestamp, signature string")
    got = [{(r.page_id, r.ts): r.streak for r in changes.streaks(df, ["page_id"], ["ts"], "signature", part).collect()} for part in (None, F.date_trunc("minute", "ts"), F.date_trunc("second", "ts"))]
    assert got[0] == got[1] == got[2] and max(got[0].values()) == 50


def test_pages_are_forgotten(spark, tmp_path):
    schema = "page_id string, ts timestamp, signature string"
    stuck = [("p", at(1000 * i), "same") for i in range(4)]
    later = [[("q", at(3_600_000), "x")], [("q", at(7_200_000), "x")], [("q", at(7_300_000), "x")], [("p", at(7_400_000), "same")]]
    got = run(changes.guarded(stream_of(spark, [stuck, *later], schema, tmp_path)), "forgotten", tmp_path)
    # the fifth scan with one signature in a row would pause the page
    assert [r.runs for r in got if r.page_id == "p"] == [True] * 5


def test_windows_in_a_stream(spark, tmp_path):
    rows = [[("a", at(0)), ("a", at(4_000)), ("b", at(9_000))], [("a", at(12_000))], [("z", at(9_000_000))], [("z", at(18_000_000))]]
    stream = changes.windowed_counts(stream_of(spark, rows, "k string, ts timestamp", tmp_path), ["k"], "10 seconds", "5 seconds")
    got = {(r.k, r["from"], r.n) for r in run(stream, "windows", tmp_path)}
    assert {("a", at(0), 2), ("a", at(-5_000), 2), ("a", at(10_000), 1), ("a", at(5_000), 1), ("b", at(5_000), 1), ("b", at(0), 1)} <= got
