"""The pipeline's first stages judge each row on its own, whatever its doc_id."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Anna has 12 apples and gives 3 apples to her brother Tom. How many apples does Anna have left today?"


def stage(spark, tmp_path, run, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in run(spark, docs, str(tmp_path)).collect()), key=str)


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(4))
    clean = [(None, a), (None, b), (1, c), (0, d)]
    want = sorted(clean, key=str)
    assert stage(spark, tmp_path, corpus_pipeline.quality, [*clean, (None, "bad " * 40), (1, "short"), (None, "")]) == want
    # an edited copy goes, with an id or without
    assert stage(spark, tmp_path, corpus_pipeline.near_duplicates, [*clean, (None, c + " more"), (None, d), (7, c + " more"), (None, a)]) == want
    copies = [ITEM.replace("12", "7").replace("3", "5").replace("Tom", "Bob"), ITEM.replace("12", "9").replace("3", "4").replace("Tom", "Max")]
    assert stage(spark, tmp_path, corpus_pipeline.decontaminate, [*clean, *((None, t) for t in copies), *((1, t) for t in copies)]) == want


def test_other_columns_and_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_row", "_whole", "row", "size", "shard", "position", "n", "doc", "hash", "_doc", "item_id"]
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, long, "en", "a", len(long), *names), (2, "some other words of a text that is kept, as it is no copy of the first one", "en", None, 5, *names), (2, long + " x", "en", "a", 5, *names)]
    docs = spark.createDataFrame(rows, ", ".join([SCHEMA, *(f"{n} string" for n in names)]))
    columns = docs.columns
    for _, run in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(run(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {1, 2}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.text[:9] for r in last} == {"w0 w1 w2 ", "some othe"} and {r._row for r in last} == {"_row"} and all(isinstance(r.shard, int) for r in last)
