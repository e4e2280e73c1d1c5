"""Byte-level BPE by prefix dynamic programming: encoding, appending, re-encoding after an edit, decoding.

The encoding of every prefix of a piece of bytes ends with one token only, and the rest of it is the encoding of
the shorter prefix. So a list of last tokens, one per prefix, holds all encodings. The last token of a prefix is the
vocabulary token at its end which the merges would leave next to the last token of what comes before;
an Aho-Corasick automaton gives the tokens that end at each byte. Bytes appended only add entries, and after an edit
the entries before it stay.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import forget_half
from .shipping import ship

#: A worker remembers so many pieces of text, each of at most so many characters.
MEMORY, LONGEST = 300_000, 48
WIDTH = 4


class Ranks:
    """The merges of a vocabulary given as ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            made = self._merge(token, rank)
            self.parts[rank] = None if len(token) == 1 else tuple(made) if len(made) == 2 else None
            if len(token) == 1 or len(made) == 2:
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()

    def _merge(self, text: bytes, below: int) -> list[int]:
        """Merge the bytes of ``text`` by the ranks under ``below``, lowest first and leftmost on ties."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if best[0] >= below:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with exactly these two.

        Merges inside each token happen in the order of their ranks. Take them back, latest first: at
        every moment the two tokens that then touched must not have formed a token of lower rank than the merge
        that came next.
        """
        key = (left, right)
        known = self.fit.get(key)
        if known is not None:
            return known
        tokens, ranks = self.tokens, self.ranks
        a, b, before = left, right, len(ranks) + 1
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            # A merge across the border comes before a merge of equal rank on its right, after one on its left.
            if across is not None and across < before:
                answer = False
                break
            split_a, split_b = self.parts[a], self.parts[b]
            if split_a is None and split_b is None:
                answer = True
                break
            if split_b is None or (split_a is not None and a > b):
                a, before = split_a[1], a
            else:
                b, before = split_b[0], b + 1
        forget_half(self.fit, MEMORY)
        self.fit[key] = answer
        return answer


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no entry before them changes."""
        back = max(0, len(self.data) - self.ranks.longest)  # tokens that end at a new byte begin here or later
        last, apart, known = self.last, self.ranks.stay_apart, self.ranks.fit.get
        self.data += more
        done = len(last)
        # At each byte the automaton gives the longest token first.
        for end, (length, rank) in self.ranks.ends.iter(self.data[back:].decode("latin-1")):
            at = end + back
            if at < done:
                continue
            before = at - length
            if before >= 0:
                fits = known((last[before], rank))
                if not (apart(last[before], rank) if fits is None else fits):
                    continue
            last.append(rank)
            done += 1
        if done != len(self.data):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace the bytes from ``start`` to ``end``; only entries from ``start`` on are made anew."""
        rest = new + self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(rest)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the prefix of ``upto`` bytes, or of all."""
        at, out = len(self.data) if upto is None else upto, []
        while at:
            rank = self.last[at - 1]
            out.append(rank)
            at -= len(self.ranks.tokens[rank])
        return out[::-1]


class Codec:
    """Encodes texts piece by piece; ids are held as little-endian 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.table = Ranks(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.table.ranks.get(data)  # a piece that is a token stays one
        ids = [whole] if whole is not None else Prefixes(self.table, data).ids()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST:
            forget_half(self.known, MEMORY)
            self.known[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        get, piece = self.known.get, self.piece
        return b"".join([get(p) or piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        tokens = self.table.tokens
        return b"".join([tokens[k] for k in memoryview(packed).cast("I").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row; ``ids`` are little-endian unsigned 32-bit integers, one after the other.

    ``path`` names a rank file that every executor has. Each match of ``pattern`` is encoded by itself; special tokens
    are ordinary text. Null and empty texts have no ids. Repeated rows stay; ids of documents may be null. An empty table
    gives an empty result. Other columns are left out. A single run without a match for the pattern is handled whole.
    """
    ship(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for row in range(0, batch.num_rows, 256):
                ids = [own.encode(t.as_py() or "") for t in texts.slice(row, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 256), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(encoded, f"`{id_col}` long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, bytes) of rows (id_col, ids); null ids are as none."""
    ship(encoded.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                ids = [k.as_py() or b"" for k in batch.column(1).slice(row, 256)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, 256),
                        pa.array([len(k) // WIDTH for k in ids], pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in ids]),
                        pa.array([own.decode(k) for k in ids], pa.binary()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "bytes"],
                )

    return encoded.select(id_col, "ids").mapInArrow(decoded, f"`{id_col}` long, n_tokens long, ids_sha256 string, bytes binary")
