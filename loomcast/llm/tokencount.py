"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary lists, for each place of a text, the pieces that
end there; a Viterbi pass keeps for each place the best score and the number of pieces that
reach it, and nothing else. Ties follow the tokenizer: of equally good ways to reach a place,
the one whose last piece is longest wins. A character that no way covers costs the lowest score
less 10 and counts as its UTF-8 bytes, which stand in for it.

No piece has a space after another character, nor any line feed; so a text falls into units of
white space and a word whose best ways are independent, and each distinct unit of a batch is
solved once. Scores of the vocabulary are whole numbers, so sums and ties are exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .common import documents, id_array, ids, map_texts, texts

COUNTS = "doc_id long, n_tokens long, score double"
SPACE = "▁"
#: Distinct units whose solution a worker keeps.
CACHE_UNITS = 1_000_000


@dataclass
class Vocabulary:
    """Pieces with their scores; control, unknown and byte pieces are left out, as they match no text."""

    pieces: dict[str, float]
    lowest: float

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        pieces = {model.id_to_piece(i): model.get_score(i) for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(pieces, min(model.get_score(i) for i in size))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.unknown = vocabulary.lowest - 10.0
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(p) for p in vocabulary.pieces):
            raise ValueError("a piece holds a space after another character; units would not be independent")
        used = {c for p in vocabulary.pieces for c in p}
        self.separator = np.zeros(256, dtype=bool)
        self.separator[[b for b in (9, 10, 11, 12, 13, 32) if b == 32 or chr(b) not in used]] = True
        self.known: dict[bytes, tuple[int, float]] = {}

    def solve(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text in which spaces are already pieces of the vocabulary."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        reached = 0
        single, unknown = self.single, self.unknown
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            while reached < end - 1:
                reached += 1
                self._unknown(text, reached, best, count, None)
            value = best[end - size] + score
            if reached < end or value > best[end]:
                if reached < end:
                    reached = end
                best[end], count[end] = value, count[end - size] + 1
                if text[end - 1] not in single and best[end - 1] + unknown > value:
                    self._unknown(text, end, best, count, value)
        while reached < n:
            reached += 1
            self._unknown(text, reached, best, count, None)
        return count[n], best[n]

    def _unknown(self, text: str, end: int, best: list[float], count: list[int], than: float | None) -> None:
        value = best[end - 1] + self.unknown
        if than is None or value > than:
            best[end], count[end] = value, count[end - 1] + len(text[end - 1].encode())

    def count_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of each text."""
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        data, offsets = K.text_buffer(column)
        if SPACE.encode() in data.tobytes():  # means a space wherever a text has it
            data, offsets = K.text_buffer(pc.replace_substring(column, SPACE, " "))
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        full = lengths > 0
        begin = offsets[:-1] + np.cumsum(full) - full
        buffer = np.full(len(data) + int(full.sum()), 32, np.uint8)  # a space before each text
        own = np.ones(len(buffer), dtype=bool)
        own[begin[full]] = False
        buffer[own] = data
        bounds = np.append(begin, len(buffer))
        words = K.split_words(buffer, bounds, self.separator)
        ends = np.unique(np.concatenate([words.end, bounds[1:][full]]))
        if not len(ends):
            return np.zeros(n, np.int64), np.zeros(n)
        starts = np.concatenate([[0], ends[:-1]])
        inverse, distinct = K.span_codes(buffer, starts, ends)
        known, solved = self.known, []
        for unit in distinct.to_pylist():
            if (found := known.get(unit)) is None:
                found = known[unit] = self.solve(unit.decode("utf-8", "replace").replace(" ", SPACE))
            solved.append(found)
        counts = np.array([c for c, _ in solved], np.int64)[inverse]
        scores = np.array([s for _, s in solved], np.float64)[inverse]
        first = np.searchsorted(starts, bounds)
        doc = np.repeat(np.arange(n), np.diff(first))
        return np.bincount(doc, counts, n).astype(np.int64), np.bincount(doc, scores, n)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter, with its cache, for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(Vocabulary.load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of COUNTS for each document: the tokens of its whole text and the score of the best way.

    `vocabulary` is the path of a piece model. A null or empty text has no tokens.
    """

    def make():
        solver = counter(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, scores = solver.count_batch(texts(batch))
            return pa.RecordBatch.from_arrays([id_array(ids(batch)), pa.array(counts), pa.array(scores)], names=["doc_id", "n_tokens", "score"])

        return each

    return map_texts(documents(docs, id_col, text_col), make, COUNTS)
