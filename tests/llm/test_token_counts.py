import random

import pytest

from quotelens.llm.token_counts import MARK, Vocabulary, WordCounter, token_counts

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.from_sentencepiece(PATH)


def library(vocabulary):
    """The same vocabulary in a tokenizer library, with byte fallback."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    bytes_ = [f"<0x{b:02X}>" for b in range(256)]
    low = min(vocabulary.scores)
    pieces = [("<unk>", low), *zip(vocabulary.pieces, vocabulary.scores), *((b, low) for b in bytes_)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="first", split=False)
    return t


def test_equals_library(vocabulary):
    rng = random.Random(4)
    counter, tokenizer = WordCounter(vocabulary), library(vocabulary)
    letters = "aaeeiostnrlé ß,.  \n漢字🙂\t0129"
    texts = ["\n", "\n\n a", "\na", " \na", "  a", " ", "a" + " " * 16 + "b", "x  y   z", "a ", "a  \n   b", "▁a▁▁b"] + ["".join(rng.choice(["  ", " ", "    ", "ab", "the", "\n", "="]) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        assert counter.count(text)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_vocabulary(vocabulary):
    """All pieces of the file count, runs of spaces too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    assert list(vocabulary.pieces) == normal and sum(MARK in p[1:] for p in normal) > 10
    assert WordCounter(vocabulary).count("a" + " " * 16 + "b")[0] <= 4


def test_ties_and_unknown():
    v = Vocabulary(("a", "b", "ab", "aba"), (-1.0, -1.0, -2.0, -3.0))
    counter = WordCounter(v)
    assert counter.segment("aba") == (-3.0, 1)  # of equal scores, the longest last piece
    assert counter.segment("é") == (-13.0, 2)
    assert WordCounter(Vocabulary((), ())).count("ab")[0] == 5


def test_rows(spark, vocabulary):
    rows = [("x y", 1, "k"), (None, 2, "k"), ("", 3, "k"), ("x y", 1, "k"), ("word " * 5000, None, "k")]
    got = sorted(token_counts(spark.createDataFrame(rows, "text string, doc_id long, n_tokens string"), vocabulary).collect(), key=str)
    counter = WordCounter(vocabulary)
    assert got == sorted([(d, counter.count(t or "")[0], round(counter.count(t or "")[1], 6)) for t, d, _ in rows], key=str)
    assert token_counts(spark.createDataFrame([], "text string, doc_id long"), vocabulary).collect() == []
