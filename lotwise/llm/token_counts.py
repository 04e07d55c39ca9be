"""Count-only unigram segmentation.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic
programming carries the best score and its number of pieces, and nothing else. Scores are added from
left to right in double precision. Of equal scores the longest last piece wins, and characters that no
single-character piece covers cost ``unknown_score``; a run of them counts as one piece. These are the
rules of the public ``tokenizers`` library's unigram model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 300_000
#: A word longer than this is counted, but not remembered.
LONGEST_REMEMBERED = 100


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece file with log probabilities.

    Files of another kind than unigram keep merge ranks in place of probabilities; those pieces get
    the Zipf estimate for their rank. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    harmonic = sum(1.0 / r for r in range(1, len(ids) + 1))
    return tuple((model.id_to_piece(i), -math.log(rank * harmonic)) for rank, i in enumerate(ids, 1))


class UnigramCounter:
    """Number of pieces of a text under a unigram vocabulary."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...], unknown_penalty: float = 10.0):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        self.unknown_score = min((score for _, score in vocabulary), default=0.0) - unknown_penalty
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        for piece, score in vocabulary:
            self.pieces.add_word(piece, (len(piece), score))
        if vocabulary:
            self.pieces.make_automaton()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word; the marks of spaces are ordinary characters here."""
        n = len(word)
        if self.single.issuperset(word):  # no unknown character: matches come end by end, the longest first
            best, count = [-math.inf] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for end, (length, score) in self.pieces.iter(word):
                start = end + 1 - length
                if (total := best[start] + score) > best[end + 1]:
                    best[end + 1] = total
                    count[end + 1] = count[start] + 1
            return count[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.pieces):
            for end, found in self.pieces.iter(word):
                ending[end].append(found)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            # Longest first: a shorter one has to be strictly better.
            options = sorted(((length, score, False) for length, score in ending[end - 1]), reverse=True)
            if word[end - 1] not in self.single:
                options.append((1, self.unknown_score, True))
            top = -math.inf
            for length, score, is_unknown in options:
                if (total := best[end - length] + score) > top:
                    top, best[end] = total, total
                    count[end] = count[end - length] + (not (is_unknown and unknown[end - length]))
                    unknown[end] = is_unknown
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a text: spaces become marks, one stands in front, and every mark begins a word."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if words[0] == "":
            words.pop(0)
        total, known = 0, self.known
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.word(SPACE + word)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(load_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document row: doc_id, n_chars and n_tokens of the whole text.

    The vocabulary file must be readable at ``vocabulary_path`` on every executor. Null and empty
    texts have no tokens; null ids and repeated rows are counted like any row; an empty table gives
    no rows; extra columns are not read. Nothing is shuffled; a lost task is simply run again.
    """

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(vocabulary_path)
        for texts in batches:
            yield pd.Series([counter.text(t or "") for t in texts], dtype="int64")

    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"), counted("text").alias("n_tokens"))
