"""Token counts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers: below the least score
MARK = "▁"  # fixed value: stands for the blank before a word
ODD_BREAKS = re.compile("[\x1c-\x1f]")  # str.split() takes these as white space, Unicode doesn't
SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")  # Unicode White_Space


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece vocabulary file, normal pieces only, scored by Zipf's law.

    The file's own order is that of frequency, and its scores are merge ranks, not log-probabilities; a piece's
    score here is minus the logarithm of its place.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [(p, -math.log(i + 2.0)) for i, p in enumerate(normal)]


class Counter:
    """Counts the pieces of the best segmentation of words, exactly as unigram tokenizers choose it."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        if pieces:
            self.matches.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.pieces = bool(pieces)
        self.of_word = lru_cache(1 << 18)(self._of_word)

    def _of_word(self, word: str) -> int:
        """Viterbi over match ends. score[e], count[e]: of the best path to e; open[e]: whether it ends in an unknown.

        A path is replaced by a strictly better one only, and paths to an end are tried in the order of their
        starts; a character without a piece of its own may be unknown at the penalty, tried after the longer
        pieces; neighbouring unknowns count once.
        """
        text = MARK + word
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if self.pieces:
            for last, (length, score) in self.matches.iter(text):
                ending[last + 1].append((length, score))
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, start, unknown, single = -math.inf, -1, False, False
            for length, own in sorted(ending[end], reverse=True):
                single |= length == 1
                if score[end - length] + own > best:
                    best, start, unknown = score[end - length] + own, end - length, False
            if not single and score[end - 1] + self.unknown > best:
                best, start, unknown = score[end - 1] + self.unknown, end - 1, True
            score[end], open_[end] = best, unknown
            count[end] = count[start] + (not (unknown and open_[start]))
        return count[n]

    def of_text(self, text: str) -> int:
        words = SPLIT.split(text.strip()) if ODD_BREAKS.search(text) else text.split()
        count = self.of_word
        return sum([count(w) for w in words if w])


def token_count(text: Column, pieces: list[tuple[str, float]]) -> Column:
    """Number of tokens (long) of whole texts; null and blank texts have 0.

    Texts are split at Unicode white space; each word takes the mark of a preceding blank. Counts of frequent
    words are kept in each worker, in a cache of fixed size.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(pieces)
        for s in batches:
            yield pd.Series([0 if t is None else counter.of_text(t) for t in s], dtype="int64")

    return counted(text)


def with_token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, which replaces a column of that name; repeated rows stay."""
    return docs.withColumn("n_tokens", token_count(F.col(text_col), read_pieces(vocabulary)))
