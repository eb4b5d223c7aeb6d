"""Rows that share a key, or have none: each text counts by itself, and no part of a table holds them all."""

from pyspark.sql import functions as F

from quotelens.llm import decontamination, mixing, sharding

ITEM = "If a farmer sells 14 baskets of apples on Monday and 9 baskets on Tuesday then how many baskets are sold in all"
COPIES = ["Before it. " + ITEM.replace("14", "31").replace("9", "7").replace("apples", "pears") + " and more.", "Other words. " + ITEM.replace("14", "52").replace("9", "8") + " here."]


def test_copies_under_equal_keys_are_found(spark):
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    found = {}
    for keys in ((1, 2), (1, 1), (None, None)):
        docs = spark.createDataFrame(list(zip(keys, COPIES)), "doc_id long, text string")
        found[keys] = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 2): {(1, 5), (2, 5)}, (1, 1): {(1, 5)}, (None, None): {(None, 5)}}
    twice = spark.createDataFrame([(1, COPIES[0]), (1, COPIES[0])], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontamination.contaminated(twice, items).collect()] == [(1, 5)]


def test_slots_of_one_key_lie_in_many_parts(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = sharding.shard_rows(docs, sharding.HashTree.uniform(1, 1, 2))
    assert sorted(r.slot for r in got.collect()) == list(range(3000))
    part = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), "size", "text_crc32"), F.lit(sharding.SLOT_PARTS))
    assert got.groupBy(part).count().agg(F.max("count")).first()[0] < 30


def test_cut_text_is_the_same_in_reruns(spark):
    rows = [(None, "s", f"{w} one two three") for w in "abcdefghij"] + [(None, "t", "x")]
    taken = [{r["row"].text: (r.taken, r.position) for r in mixing.mix(spark.createDataFrame(part, "doc_id long, source string, text string").repartition(n), mixing.words_in(F.col("text"))).collect()} for part, n in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 7))]
    assert taken[0] == taken[1] == taken[2]
