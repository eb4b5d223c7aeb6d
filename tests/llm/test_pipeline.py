"""The pipeline against plain Python, stage by stage."""

import random
from collections import Counter

import corpus_pipeline
from test_near_dedup import brute as brute_groups
from test_other_operators import brute_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Anna has 12 apples and gives 3 apples to her brother Tom. How many apples does Anna have left today?"


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows = [(i, text(rng.randint(12, 80)), "en", rng.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(10)]  # exact copies
    rows += [(120 + i, f"{text(3)} {ITEM} {text(20)}", "en", "a") for i in range(3)] + [(130, "again and " * 40, "en", "a"), (131, None, "en", "a"), (132, "", None, "b"), (None, text(30), "en", "c"), rows[3]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {i: t for i, t, *_ in rows}
    texts = {i: [t or "" for j, t, *_ in rows if j == i] for i in left}
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        outs.append([r.asDict() for r in docs.collect()])
    good = {i for i, t in left.items() if t and i != 130}
    assert {r["doc_id"] for r in outs[0]} == good and len(outs[0]) == len(good) + 1  # one row comes twice
    kept = {d for d, _, _, k in brute_groups([(i, left[i]) for i in good]) if k}
    assert Counter(r["doc_id"] for r in outs[1]) == Counter(kept)
    assert {r["doc_id"] for r in outs[2]} == kept - {120, 121, 122}
    assert all(set(r) == {"doc_id", "text", "lang", "source", "n_chars"} for out in outs[:4] for r in out)
    _, target = brute_mix([(r["text"], r["doc_id"], r["source"]) for r in outs[2]])
    words = Counter()
    for r in outs[3]:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())  # the last row of a source is cut
    assert all(r["n_chars"] == len(r["text"]) and any(left_text.startswith(r["text"]) for left_text in texts[r["doc_id"]]) for r in outs[3])
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    rows_of = lambda out: Counter(tuple(r[c] for c in columns) for r in out)
    assert rows_of(outs[4]) == rows_of(outs[3]) and {r["law"] for r in outs[4]} == {"key"}
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("slot").collect())) == Counter(map(str, docs.drop("slot").collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
