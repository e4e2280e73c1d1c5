"""Vector bin packing of training examples into sequences.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens. The next piece of a
sequence is, of the examples at hand that fit whole, the one with the largest dot product of its needs and the
sequence's remaining room, each in shares of the limits. If none fits, the one with the largest product is cut, and the rest of it
stays at hand. A sequence that ends below its token limit (by another limit, or for want of examples) is cut back to a
power of two, so none needs padding. Each task packs its own rows as they come, with a bounded number at hand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .memory import forget_half
from .shipping import ship

#: Examples at hand in a task.
AT_HAND = 256
#: A worker remembers so many words, each of at most so many bytes.
MEMORY, LONGEST = 400_000, 48
WIDTH = 4


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Piece(NamedTuple):
    """Tokens ``start`` to ``start + length`` of an example; the last ``loss`` of them bear loss."""

    owner: int | None
    start: int
    length: int
    loss: int
    total: int
    ids: bytes

    def cut(self, k: int) -> tuple[Piece, Piece]:
        """The first k tokens and the rest."""
        plain = self.length - self.loss
        first = Piece(self.owner, self.start, k, max(0, k - plain), self.total, self.ids[: k * WIDTH])
        rest = Piece(self.owner, self.start + k, self.length - k, self.loss - first.loss, self.total, self.ids[k * WIDTH :])
        return first, rest

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        most = self.length if self.loss <= loss else self.length - self.loss + loss
        return min(most, tokens)


class Packer:
    """Holds the examples at hand and makes one sequence after the other."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.at_hand: list[Piece] = []
        self.need = np.zeros((AT_HAND + limits.segments + 1, 2), np.int64)

    def add(self, piece: Piece) -> None:
        if not piece.length:
            return
        if len(self.at_hand) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.at_hand)] = piece.length, piece.loss
        self.at_hand.append(piece)

    def _take(self, k: int) -> Piece:
        piece, last = self.at_hand[k], self.at_hand.pop()
        if k < len(self.at_hand):
            self.at_hand[k] = last
            self.need[k] = self.need[len(self.at_hand)]
        return piece

    def sequence(self) -> list[Piece]:
        """The pieces of the next sequence, of what is at hand."""
        limits, out = self.limits, []
        tokens, segments, loss = limits
        while tokens and segments and self.at_hand:
            need = self.need[: len(self.at_hand)]
            value = need[:, 0] * (tokens / limits.tokens**2) + need[:, 1] * (loss / limits.loss**2) + segments / limits.segments**2
            whole = (need[:, 0] <= tokens) & (need[:, 1] <= loss)
            k = int(np.argmax(np.where(whole, value, -1.0)))
            if not whole[k]:
                # The most of what still fits; a piece that would begin with a token too many waits.
                part = np.minimum(np.where(need[:, 1] <= loss, need[:, 0], need[:, 0] - need[:, 1] + loss), tokens)
                k = int(np.argmax(np.where(part > 0, value, -1.0)))
                if part[k] <= 0:
                    break
                piece, rest = self._take(k).cut(int(part[k]))
                self.add(rest)
            else:
                piece = self._take(k)
            out.append(piece)
            tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.loss
        return self._rounded(out, limits.tokens - tokens)

    def _rounded(self, pieces: list[Piece], length: int) -> list[Piece]:
        """The pieces cut back to a power of two, if they don't reach the limit."""
        if length == self.limits.tokens or not length:
            return pieces
        excess = length - (1 << (length.bit_length() - 1))
        while excess:
            piece = pieces.pop()
            if piece.length > excess:
                first, rest = piece.cut(piece.length - excess)
                pieces.append(first)
                self.add(rest)
                break
            excess -= piece.length
            self.add(piece)
        return pieces


def packed_sequences(examples: Iterator[Piece], limits: Limits) -> Iterator[list[Piece]]:
    packer = Packer(limits)
    for example in examples:
        while example.length > limits.tokens and example.fitting(limits.tokens, limits.loss) == limits.tokens:
            first, example = example.cut(limits.tokens)
            yield [first]
        packer.add(example)
        while len(packer.at_hand) >= AT_HAND:
            yield packer.sequence()
    while packer.at_hand:
        yield packer.sequence()


PIECE_SCHEMA = "start long, length long, loss long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_examples(examples: DataFrame, id_col: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """One row per piece of the rows (id_col, ids, loss): id_col, start, length, loss, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit integers; the last ``loss`` of an example's tokens bear loss (null: all).
    Every token is in exactly one piece; ``offset`` counts a sequence's tokens before the piece. Sequences hold at most ``limits`` and are
    full or a power of two long. Null or empty ids give no piece. Repeated rows are examples of their own; ids of examples may
    be null. An empty table gives an empty result. There is no shuffle: a sequence holds rows of one
    task, whose number is in its id. The input should be a table, so that a task made anew packs the same rows.
    """
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    ship(examples.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for owner, ids, loss in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    ids, loss = ids.as_py() or b"", loss.as_py()
                    n = len(ids) // WIDTH
                    yield Piece(owner.as_py(), 0, n, n if loss is None else min(max(loss, 0), n), n, ids)

        first = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = zip(*rows, strict=True)
            names = [id_col, "start", "length", "loss", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for number, sequence in enumerate(packed_sequences(pieces(), limits)):
            at = 0
            for p in sequence:
                rows.append((p.owner, p.start, p.length, p.loss, p.total, first + number, at, p.ids))
                at += p.length
            if len(rows) >= 1000:
                yield made()
                rows.clear()
        if rows:
            yield made()

    own = examples.select(F.col(id_col).cast("long").alias(id_col), "ids", F.col("loss").cast("long").alias("loss"))
    return own.mapInArrow(packed, f"`{id_col}` long, {PIECE_SCHEMA}")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and up in turn."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordCodec:
    """Encodes texts by a vocabulary that lower-cases and ignores white space, remembering words.

    No token spans white space, so words are encoded by themselves. A word of plain letters goes to the
    library's merges directly, any other through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        bare = word.rstrip(b".,;:!?")
        if bare and bare != word and (plain := self._plain(bare)) is not None:
            tail = word[len(bare) :]
            ids = (self.known.get(bare) or self._keep(bare, plain)) + (self.known.get(tail) or self.word(tail))
        elif (plain := self._plain(word)) is not None:
            return self._keep(word, plain)
        else:
            ids = self._packed(self.whole.encode(word.decode(), add_special_tokens=False).ids)
        return self._remember(word, ids)

    def _plain(self, word: bytes) -> str | None:
        text = word.decode()
        return text if text.isalpha() and max(text) <= "ÿ" else None

    def _keep(self, word: bytes, text: str) -> bytes:
        letters = "".join([self.letters[b] for b in text.lower().encode()])
        return self._remember(word, self._packed([t.id for t in self.merges.tokenize(letters)]))

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            forget_half(self.known, MEMORY)
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" not in data:  # special tokens keep their case
            data = data.lower()
        get, word, words = self.known.get, self.word, data.split()
        found = [get(w) for w in words]
        if None in found:
            found = [ids if ids is not None else get(w) or word(w) for ids, w in zip(found, words, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    """One per worker."""
    return WordCodec(path)


def tokenize_documents(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, loss): the ids of each text by the tokenizers library, then ``end_id``; null and empty texts have that alone."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_codec(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                ids = [own.encode(t.as_py() or "") + end for t in batch.column(1).slice(row, 256)]
                few = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 256), pa.array(ids, pa.binary()), pa.nulls(few, pa.int64())], names=[id_col, "ids", "loss"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(encoded, f"`{id_col}` long, ids binary, loss long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """``pack_examples`` of whole documents, every token of which bears loss. Edge cases as there and in ``tokenize_documents``."""
    return pack_examples(tokenize_documents(docs, path, end_id), "doc_id", limits)
