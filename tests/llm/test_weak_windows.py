"""Decontamination by items whose windows have few literal words."""

from quotelens.llm import decontamination

ITEMS = [
    (1, "What is 7 times 8?"),
    (2, "Der Hund und die Katze von Frau Meyer laufen mit Peter durch Garten, Wald und Feld."),
    (3, "1 2 3 4 5 6 7 8 9 10"),
    (4, "Berlin Hamburg 17"),
    (5, "Add up 3 kg, 4 kg, 5 kg and 9 kg, then take 2 kg from 8 kg."),
]


def found(spark, texts, templates=decontamination.Templates()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), templates=templates).collect()}


def test_every_item_is_found_as_a_verbatim_copy(spark):
    texts = [t for _, t in ITEMS] + [f"Now for once he said {t} And no more of it." for _, t in ITEMS]
    for templates in (decontamination.Templates(), decontamination.Templates(broadcast=0)):
        assert found(spark, texts, templates) == {(i, i % 5 + 1) for i in range(10)}


def test_other_values_need_more_evidence(spark):
    texts = [
        "What is 3 times 4?",
        "What is 3 times 3?",  # one value for two
        "Der Mann und die Frau von Herr Schulz laufen mit Hans durch Park, Dorf und Stadt.",
        "11 12 13 14 15 16 17 18 19 20",
        "Paris London 17",
        "Add up 13 kg, 14 kg, 15 kg and 19 kg, then take 12 kg from 18 kg.",
        "Then 13 kg, 14 kg, 15 kg and 19 kg are what he and she had.",
    ]
    assert found(spark, texts) == {(0, 1), (2, 2), (5, 5)}
