"""Token counts without tokens: Viterbi over a unigram vocabulary, carrying best score and piece count only."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Added to the smallest score for a character that no piece covers (a fixed value of unigram tokenizers).
UNKNOWN_PENALTY = 10.0


class PieceCounter(dict):
    """Pieces in a segment (a run of marks and the characters up to the next mark); remembers a bounded number of segments.

    The tokenizer's rules: positions are visited from left to right; a later candidate for the same end wins only with a
    strictly higher score, so among equals the longest last piece stays; a character that is no piece is unknown at the
    smallest score less UNKNOWN_PENALTY and costs one piece for each UTF-8 byte.
    """

    bound = 200_000

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        #: No piece runs on over a mark, so the best path is the best path of each segment.
        self.splits = not any(MARK in piece.lstrip(MARK) for piece, _ in pieces)

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)
        if len(segment) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[segment] = n
        return n

    def viterbi(self, s: str) -> int:
        best, count = [0.0] + [None] * len(s), [0] * (len(s) + 1)
        at = 0

        def unknowns(upto: int) -> None:
            nonlocal at
            while at < upto:  # ends that no piece of one character reaches may still need the unknown candidate
                at += 1
                if not single[at]:
                    c = best[at - 1] + self.unknown
                    if best[at] is None or c > best[at]:
                        best[at], count[at] = c, count[at - 1] + len(s[at - 1].encode())

        single = [False] * (len(s) + 1)
        for end, (length, score) in self.machine.iter(s):
            unknowns(end)  # all ends before this one are final now
            if length == 1:
                single[end + 1] = True
            c = best[end + 1 - length] + score
            if best[end + 1] is None or c > best[end + 1]:
                best[end + 1], count[end + 1] = c, count[end + 1 - length] + 1
        unknowns(len(s))
        return count[len(s)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, re.findall(f"{MARK}+[^{MARK}]*", s))) if self.splits else self.viterbi(s)


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    """The pieces of a sentencepiece file with their scores, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return PieceCounter([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) of every row, by whole text and without a shuffle.

    A null or empty text has 0 tokens, a null id stays null, repeated rows are counted each, an empty table gives an
    empty one, and other columns of docs play no part, whatever their names. Very long texts: memory grows with the
    longest run without a space only.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = load(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.count(x or "") for x in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")
