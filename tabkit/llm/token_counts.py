"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming over the
characters carries the best score and its number of pieces. Ties go by the rules of the tokenizers library's Unigram model:
a later candidate replaces an earlier one only if its score is higher, and candidates for an end come with the earliest
start (the longest piece) first. A character that is no piece itself may also be unknown, at the lowest
score less 10; it counts as its UTF-8 bytes if the vocabulary has a piece for each, else a run of such characters counts as
one. Scores are 64-bit floats. Texts are cut before each blank, which becomes the mark that begins a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker remembers so many words, each of at most so many characters.
MEMORY, LONGEST = 400_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.ends = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.ends.add_word(piece, (len(piece), score))
        self.ends.make_automaton()
        self.known: dict[str, int] = {}
        self.counts, self.scores = np.zeros(MEMORY, np.int64), np.zeros(MEMORY)

    def best(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation."""
        n = len(word)
        score, count, is_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        hits = self.ends.iter(word)
        end, hit = next(hits, (n, None))
        for at in range(n):
            best, single, to = None, False, at + 1
            while end == at:
                length, own = hit
                total = score[to - length] + own
                if best is None or total > best:
                    best, count[to] = total, count[to - length] + 1
                single = length == 1  # the shortest piece comes last
                end, hit = next(hits, (n, None))
            if not single:
                total = score[at] + self.unknown
                if best is None or total > best:
                    best, is_unknown[to] = total, True
                    more = len(word[at].encode()) if self.by_bytes else int(not is_unknown[at])
                    count[to] = count[at] + more
            score[to] = best
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        text = text.replace(MARK, " ")
        if not text:
            return 0, 0.0
        words = text[text[0] == " " :].split(" ")
        known, extra, total, where = self.known, 0, 0.0, []
        for word in words:
            at = known.get(word)
            if at is None:
                count, score = self.best(MARK + word)
                if len(word) > LONGEST:
                    extra, total = extra + count, total + score
                    continue
                if len(known) >= MEMORY:
                    sums = np.array(where, np.int64)
                    extra, total, where = extra + int(self.counts[sums].sum()), total + float(self.scores[sums].sum()), []
                    known.clear()
                at = known[word] = len(known)
                self.counts[at], self.scores[at] = count, score
            where.append(at)
        sums = np.array(where, np.int64)
        return extra + int(self.counts[sums].sum()), total + float(self.scores[sums].sum())


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, score) of every row.

    ``path`` names a SentencePiece model file that every executor has; its pieces and scores are the unigram
    vocabulary. Null and empty texts have no tokens. Repeated rows stay; ids may be null; an empty table gives an empty
    result. Other columns are left out. A text without blanks is one word, handled whole.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            found = [own.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=[id_col, "n_tokens", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(counted, f"`{id_col}` long, n_tokens long, score double")
