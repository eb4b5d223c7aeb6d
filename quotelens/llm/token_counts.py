"""Numbers of tokens of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word, and dynamic programming over their ends carries the
best score and its number of tokens. Rules are those of the common unigram implementations, in double precision: among
equal scores the piece that begins first (the longest) wins; a character that no piece of one character covers is unknown
and scores the smallest score less 10, and counts as its UTF-8 bytes, each a token.

A space becomes the mark that begins a word; a text that doesn't begin with a space gets one before it. In a piece marks come first, one or
more, and no piece has a line feed. So the best segmentation of a text is that of its words one by one, each with all the spaces before it,
and a word is segmented once a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: A piece, and a word with the marks before it.
PIECE, WORD = re.compile(f"{MARK}*[^{MARK}\n]*"), re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A task forgets its words when it knows so many.
KNOWN = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """pieces and their scores (logarithms of probabilities)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]

    def __post_init__(self):
        if not all(p and PIECE.fullmatch(p) for p in self.pieces) or len(set(self.pieces)) < len(self.pieces):
            raise ValueError("pieces must differ, not be empty, have marks only at the beginning, and no line feed")

    @property
    def unknown(self) -> float:
        return min(self.scores, default=0.0) - 10.0

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The normal pieces of a model file in its own order, the k-th scored -ln(k + 1) (the files hold ranks, not probabilities)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        pieces = list(map(model.id_to_piece, ids))
        return cls(tuple(pieces), tuple(-math.log(k + 1) for k in range(1, len(pieces) + 1)))


class WordCounter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.empty, self.unknown = not vocabulary.pieces, vocabulary.unknown
        self.known: dict[str, tuple[float, int]] = {}

    def segment(self, word: str) -> tuple[float, int]:
        """Score and tokens of the best segmentation of a word."""
        n = len(word)
        best = [0.0] + [-math.inf] * n
        tokens = [0] * (n + 1)
        pieces = iter(()) if self.empty else self.automaton.iter(word)
        last, found = next(pieces, (n, None))
        for end in range(n):
            at, single = -math.inf, False
            # the longest piece that ends here comes first, and only a better score replaces it
            while last == end:
                length, score = found
                start = end + 1 - length
                if best[start] + score > at:
                    at, tokens[end + 1] = best[start] + score, tokens[start] + 1
                single = single or length == 1
                last, found = next(pieces, (n, None))
            if not single and best[end] + self.unknown > at:
                at, tokens[end + 1] = best[end] + self.unknown, tokens[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1] = at
        return best[n], tokens[n]

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text; an empty text has none."""
        if not text:
            return 0, 0.0
        known, total, score = self.known, 0, 0.0
        for k, line in enumerate(text.split("\n")):
            if k:
                total += 1
                score += self.unknown
            line = line.replace(" ", MARK)
            # the text's own beginning has a mark, if only that which its first space becomes
            for word in WORD.findall(line if k or line.startswith(MARK) else MARK + line):
                if (got := known.get(word)) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[word] = got = self.segment(word)
                score += got[0]
                total += got[1]
        return total, score


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and score (of the best segmentation) of every row of docs; other columns of docs are not read.

    A null or empty text has no tokens and the score 0. The vocabulary is broadcast; its size is fixed by its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                found = [counter.count(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([round(s, 6) for _, s in found], pa.float64())], names=[key, "n_tokens", "score"])

    rows = docs.select(key, text)
    return rows.mapInArrow(count, f"`{key}` {dict(rows.dtypes)[key]}, n_tokens long, score double")
