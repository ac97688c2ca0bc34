"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a pre-token; dynamic programming keeps, for
every position, the best score and the number of pieces on the path that reaches it. Tie rules are those of the
``tokenizers`` library's unigram model: starts are tried from left to right, at one start shorter pieces first, and a
path is replaced by a strictly better one only. A position no piece of one character starts at gets an unknown piece
(least score of the vocabulary less 10) after its matches; neighbouring unknown pieces count as one.

A null text is empty and has 0 tokens; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from strata.llm.text import map_columns

#: The mark of a word's start, and how far an unknown piece lies below the least score.
WORD_START, UNKNOWN_PENALTY = "▁", 10.0
CACHED, CACHED_CHARS = 600_000, 48
WORD = re.compile(f"{WORD_START}?[^{WORD_START}]+|{WORD_START}")


def piece_scores(model: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from a sentencepiece file: its ordinary pieces in order, the piece of rank r scored as a
    Zipf law has it, -ln(r + 2)."""
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    skip = lambda i: own.is_unknown(i) or own.is_control(i) or own.is_byte(i) or own.is_unused(i)
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size()) if not skip(i)]
    return [(p, -math.log(rank + 2)) for rank, p in enumerate(pieces)]


class Counter(dict):
    """Piece counts by word, kept for short words."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = self.pieces(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n

    def pieces(self, word: str) -> int:
        """Positions in order; every match is filed under its end, longest (earliest start) first.

        A path to an end comes from an earlier start before a later one, so comparing the matches of one end by
        start is the order of the tie rule.
        """
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (size, score) in self.automaton.iter(word):
            ends[last + 1].append((last + 1 - size, score))
            if size == 1:
                single[last] = True
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            matches = ends[end]
            if len(matches) > 1:
                matches.sort()
            top, start = -math.inf, -1
            for s, score in matches:
                if best[s] + score > top:
                    top, start = best[s] + score, s
            known = True
            if not single[end - 1] and (start < 0 or best[end - 1] + self.unknown > top):
                top, start, known = best[end - 1] + self.unknown, end - 1, False
            best[end], loose[end] = top, not known
            count[end] = count[start] + (known or not loose[start])
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", WORD_START)
        if not marked.startswith(WORD_START):
            marked = WORD_START + marked
        return sum(map(self.__getitem__, WORD.findall(marked)))


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One per worker process."""
    return Counter(piece_scores(model))


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``n_tokens`` of every whole text, under the unigram vocabulary of ``model`` (:func:`piece_scores`).

    Spaces become word starts, every word start opens a pre-token, and a text without one at its beginning gets it.
    """

    def run(ids, texts):
        own = counter(model)
        return {id_col: ids, "n_tokens": [own.count(t or "") for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint")
