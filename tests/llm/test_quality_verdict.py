"""The suffix array's own verdict: texts that the base rules let pass."""

from quotelens.llm import quality_rules


def test_copied_sentences_are_rejected_where_the_base_rules_pass(spark):
    word = lambda a, b: [f"w{i}" for i in range(a, b)]
    copied = word(0, 200) + word(0, 20) + word(300, 340)  # 40 of 260 words in a repeat of 20
    phrases = word(0, 200) + word(0, 10) + word(300, 310) + word(50, 60)  # 40 of 230 in repeats of 10
    rare = word(0, 500) + word(0, 20)  # 40 of 520 in a repeat of 20
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([copied, phrases, rare])], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(got[i].covered_words, got[i].copied_words, got[i].longest_repeat, got[i].kept) for i in range(3)] == [(40, 40, 20, False), (40, 0, 10, True), (40, 40, 20, True)]
