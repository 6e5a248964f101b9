"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each
character; dynamic programming keeps the best score and its piece count. The
rules are those of the library's unigram model: scores add from the left, a
later candidate must be strictly better, candidates come by ascending start, an
unknown character scores the least score minus 10, and neighbouring unknowns
are one token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import vocabulary_path

_SPACE = "▁"
_UNKNOWN_PENALTY = 10.0


@cache
def unigram_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece model with unigram scores by Zipf's law.

    No public unigram model is at hand, so the pieces of the given file get the
    score -ln(rank + 1), rank being their place among the ordinary pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return tuple((p, -math.log(rank + 1)) for rank, p in enumerate(plain, 1))


class CountOnlyViterbi:
    """``count(text)``: how many tokens the unigram tokenizer would give."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...], max_entries: int = 600_000):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._single = {p for p, _ in vocabulary if len(p) == 1}
        self._unknown = min(s for _, s in vocabulary) - _UNKNOWN_PENALTY
        self._known: dict[str, int] = {}
        self._max = max_entries

    def word(self, word: str) -> int:
        """Pieces of one pre-token."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self._automaton.iter(word):
            at[end].append(found)
        for end in range(1, n + 1):
            best, from_, strange = None, 0, False
            for length, s in sorted(at[end - 1], reverse=True):
                if (base := score[end - length]) is not None and (best is None or s + base > best):
                    best, from_ = s + base, end - length
            if word[end - 1] not in self._single and (base := score[end - 1]) is not None:
                if best is None or self._unknown + base > best:
                    best, from_, strange = self._unknown + base, end - 1, True
            score[end], unknown[end] = best, strange
            count[end] = count[from_] + (not (strange and unknown[from_]))
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(_SPACE, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")
        counts = list(map(self._known.get, words))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    counts[i] = self._learn(words[i])
        return sum(counts)

    def _learn(self, word: str) -> int:
        if (c := self._known.get(word)) is None:
            c = self.word(_SPACE + word)
            if len(self._known) >= self._max:
                self._known.clear()
            self._known[word] = c
        return c


@cache
def counter(path: str) -> CountOnlyViterbi:
    return CountOnlyViterbi(unigram_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens (long) and n_chars_read (long) for every row of (doc_id, text).

    Whole texts are counted. Null and empty texts have 0 tokens, a null doc_id
    stays null, repeated rows give a row each, other columns are not read, an
    empty table gives no rows.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(c.count, texts), pa.int64()), pa.array(map(len, texts), pa.int64())],
                ["doc_id", "n_tokens", "n_chars_read"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_chars_read bigint")
