"""Packing: every id in one piece, whole sequences, ids of the tokenizer's own library, the plan against the histogram."""

import random

import numpy as np
import public_tokenizers
import pytest

from quotelens.llm import packing

VOCABULARY = packing.BytePairs.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", None, "a", "a", "x<|endoftext|>y", "  \n\t two  spaces　and é 漢字 🙂 don't I'LL 12345", "z" * 5000, " " * 5000, "\x00\x1c\x85 a", "word " * 9000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, documents, window):
    """documents: for each (key, text) the ids; pieces of equal keys may be of either."""
    assert sum(len(ids) for _, ids in documents) == sum(p.length for p in pieces)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for key, ids in documents:
        if sum(k == key for k, _ in documents) == 1:
            own = sorted(by_doc[key], key=lambda p: p.start)
            assert [i for p in own for i in np.frombuffer(p.ids, "<u4")] == ids and all(p.doc_tokens == len(ids) for p in own)
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= window and n & (n - 1) == 0


@pytest.mark.parametrize("window", [2, 64, 2048])
def test_odd_texts(spark, library, window):
    docs = spark.createDataFrame([(k if k != 3 else 2, t, "x", 1) for k, t in enumerate(ODD)] + [(None, "no key", "x", 1)], "doc_id long, text string, _ids string, _rank int")
    pieces = packing.pack_documents(docs.repartition(3), VOCABULARY, window=window).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    check(pieces, [(k if k != 3 else 2, ids(t)) for k, t in enumerate(ODD)] + [(None, ids("no key"))], window)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_documents_of_one_length_and_of_many(spark, library):
    rng = random.Random(4)
    texts = ["a " * 700] * 120 + [" ".join(rng.choices(["alpha", "beta", "12", "é"], k=rng.randint(1, 400))) for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, VOCABULARY, window=512).collect()
    check(pieces, [(k, [*library.encode(t, add_special_tokens=False).ids, 1]) for k, t in enumerate(texts)], 512)


def test_same_ids_as_the_library(library):
    rng, encode = random.Random(8), VOCABULARY.encoder()
    alphabet = [" ", "  ", "\n", "\t", "'s", "'S", "a", "É", "ß", "漢", "١", "½", "🙂", "​", " ", " ", "<|endoftext|>", "<|", "_", "--", "9", "the", "\r\n", "́", "\x1f", "\x85", "ͅ"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_text_that_the_fast_way_fails_on(library, monkeypatch):
    import tiktoken

    def fails(*_, **__):
        raise BaseException("panic")

    encode = VOCABULARY.encoder()
    monkeypatch.setattr(tiktoken.Encoding, "encode", fails)
    assert encode("some text") == library.encode("some text", add_special_tokens=False).ids


def test_combinations_fill_the_window():
    histogram = np.array([0, 3, 0, 2, 1, 0, 0, 4], dtype=np.int64)
    every = packing.combinations(histogram, 8)
    assert all(sum(x * t for x, t in c) == 8 and all(histogram[x] >= t for x, t in c) for c in every)
    assert {((7, 1), (1, 1)), ((4, 1), (3, 1), (1, 1)), ((3, 2), (1, 2))} <= {tuple(c) for c in every}


def test_least_squares_reaches_what_can_be_reached():
    histogram = np.zeros(100, dtype=np.int64)
    histogram[[60, 40, 70, 30, 50, 20]] = [10, 10, 7, 12, 6, 5]
    columns = packing.combinations(histogram, 100)
    counts = packing.repeat_counts(columns, histogram, 20_000, 1e-9)
    left = histogram.astype(float)
    for c, n in zip(columns, counts):
        for x, t in c:
            left[x] -= n * t
    assert min(counts) >= 0
    # at the least no combination's count can change for the better
    for c, n in zip(columns, counts):
        slope = sum(t * left[x] for x, t in c)
        assert slope < 1e-3 and (n < 1e-6 or abs(slope) < 1e-3)


def test_plan_uses_every_rest_once():
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 9, 256), np.where(np.arange(256) == 200, 1000, 0), np.where(np.arange(256) < 9, 500, 0), np.zeros(256, dtype=int)):
        histogram[0] = 0
        plan = packing.Plan.of(histogram, 3, 256)
        taken, whole = {}, 0
        for length in range(1, 256):
            for rank in range(int(histogram[length])):
                places = plan.places(length, rank)
                assert sum(n for n, _, _ in places) == length
                whole += len(places) == 1
                for n, sequence, offset in places:
                    taken.setdefault(sequence, []).append((offset, offset + n))
        assert sorted(taken) == list(range(3, 3 + len(taken)))
        for spans in taken.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert spans[-1][1] & (spans[-1][1] - 1) == 0
        if len(set(histogram)) > 3:  # many lengths: most rests stay whole
            assert whole > 0.9 * histogram.sum()
