"""Count the tokens of a unigram vocabulary without building them.

An Aho-Corasick automaton enumerates the vocabulary entries in a text; dynamic programming over
the ends of these matches carries the best score and its number of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns

#: Fixed values of the unigram model: what an unknown character costs below the lowest score, and
#: the mark that stands for a space.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Distinct words remembered by a task; beyond that the memory starts anew.
CACHED = 1 << 19


class Unigram:
    """``pieces``: (piece, score) in id order; ``bytes_for_unknown``: byte fallback.

    Ties are broken as the tokenizers do: paths are compared at each end in the order of where
    their last piece starts, and a later one wins only if its score is greater. So of equal paths
    the one with the longer last piece stays. A character that no piece of this length covers gets
    an unknown piece. Unknown characters in a row are one token, or one for each of their UTF-8
    bytes with byte fallback.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], bytes_for_unknown: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if not len(self.automaton):
            raise ValueError("an empty vocabulary")
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        # If no piece goes on with a space after something else, no piece reaches into the next
        # word; then the best path of a text is that of its words, one after the other. Unknown
        # characters in a row must not be merged over that border, as with byte fallback.
        crosses = re.compile(f"[^{SPACE}]{SPACE}")
        split = bytes_for_unknown and not any(crosses.search(p) for p, _ in pieces)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S) if split else None
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of the best path."""
        n = len(text)
        if not n:
            return 0, 0.0
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(text):
            starts[end - length + 1].append((length, score))
        scores: list[float | None] = [None] * (n + 1)
        counts = [0] * (n + 1)
        ends_unknown = [False] * (n + 1)
        scores[0] = 0.0
        for start in range(n):
            here, count = scores[start], counts[start]
            if here is None:
                continue
            single = False
            for length, score in starts[start]:
                single = single or length == 1
                end, total = start + length, here + score
                if scores[end] is None or total > scores[end]:
                    scores[end], counts[end], ends_unknown[end] = total, count + 1, False
            if not single:
                end, total = start + 1, here + self.unknown
                if scores[end] is None or total > scores[end]:
                    if self.bytes_for_unknown:
                        more = len(text[start].encode("utf-8", "replace"))
                    else:
                        more = 0 if ends_unknown[start] else 1
                    scores[end], counts[end], ends_unknown[end] = total, count + more, True
        return counts[n], scores[n]

    def count(self, text: str) -> tuple[int, float]:
        """Like ``best``, by words with a memory where that gives the same."""
        if self.words is None:
            return self.best(text)
        known, tokens, score = self.known, 0, 0.0
        for word in self.words.findall(text):
            found = known.get(word)
            if found is None:
                found = self.best(word)
                if len(known) >= CACHED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = found
            tokens += found[0]
            score += found[1]
        return tokens, score


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a SentencePiece model file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def token_counts(
    docs: DataFrame,
    pieces: Sequence[tuple[str, float]],
    *,
    bytes_for_unknown: bool = True,
    text: str = "text",
    tokens: str = "n_tokens",
    score: str = "score",
) -> DataFrame:
    """``docs`` with the number of tokens of the whole ``text`` and the score of that path.

    Spaces are read as the mark for a space, and one is put in front of the text, as the model does.
    Null and empty texts have 0 tokens and score 0. A score that lies beyond the exact integers of
    a double may differ in its last digits from a sum in another order. Repeated rows stay, other
    columns pass through, and columns called as the new ones are replaced. ``pieces`` has the fixed
    size of a vocabulary and is broadcast; over a million pieces are refused.
    """
    if len(pieces) > 1_000_000:
        raise ValueError("too many pieces for a vocabulary")
    shared = docs.sparkSession.sparkContext.broadcast((list(pieces), bytes_for_unknown))

    def setup():
        model = Unigram(*shared.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [model.count(SPACE + t.replace(" ", SPACE)) if t else (0, 0.0) for t in texts.to_pylist()]
            return [
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([s for _, s in found], pa.float64()),
            ]

        return compute

    added = T.StructType(
        [T.StructField(tokens, T.LongType()), T.StructField(score, T.DoubleType())]
    )
    return with_columns(docs, text, added, setup)
