import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabkit.llm.packing import Limits, Piece, pack_documents, pack_examples, packed_sequences

WORDS = public_tokenizers.path("word_bpe_49k.json")


def example(owner, n, loss=None):
    ids = struct.pack(f"<{n}I", *[(owner * 7 + k) % 50_000 for k in range(n)])
    return Piece(owner, 0, n, n if loss is None else loss, n, ids)


def check(examples, limits):
    parts, lengths = defaultdict(list), []
    for sequence in packed_sequences(iter(examples), limits):
        tokens = sum(p.length for p in sequence)
        assert 0 < tokens <= limits.tokens and len(sequence) <= limits.segments and sum(p.loss for p in sequence) <= limits.loss
        assert tokens == limits.tokens or tokens & (tokens - 1) == 0
        lengths.append(tokens)
        for p in sequence:
            parts[p.owner].append(p)
    for e in examples:
        at, ids, loss = 0, b"", 0
        for p in sorted(parts.pop(e.owner, []), key=lambda p: p.start):
            assert p.start == at and len(p.ids) == 4 * p.length and p.total == e.length
            at, ids, loss = at + p.length, ids + p.ids, loss + p.loss
        assert (at, ids, loss) == (e.length, e.ids, e.loss)
    assert not parts
    return lengths


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 20), Limits(64, 64, 1), Limits(100, 1, 100), Limits(1, 1, 1)])
def test_limits_hold_and_nothing_is_lost(limits):
    random.seed(limits.segments)
    sizes = [random.choice([0, 1, 2, 5, 30, 63, 64, 65, 130, 200]) for _ in range(400)]
    check([example(k, n, random.randint(0, n)) for k, n in enumerate(sizes)], limits)


def test_sequences_are_full():
    random.seed(1)
    lengths = check([example(k, random.randint(1, 3000)) for k in range(800)], Limits())
    assert sum(n != 4096 for n in lengths) <= 12


def test_documents(docs_of, edge_rows):
    library = Tokenizer.from_file(WORDS)
    rows = [*edge_rows[1:4], *edge_rows[6:], (11, "Hello, World! <|endoftext|> x"), (12, "same"), (12, "same")]
    got = pack_documents(docs_of(rows, extra=True).coalesce(2), WORDS).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        parts[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    for doc, text in rows[:-2]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert {r.doc_tokens for r in parts[doc]} == {len(ids)}
        whole = b"".join(bytes(r.ids) for r in sorted(parts[doc], key=lambda r: r.start))
        assert whole == struct.pack(f"<{len(ids)}I", *ids)
    assert sum(r.length for r in parts[12]) == 2 * parts[12][0].doc_tokens
    assert zlib.crc32(b"") == 0 and pack_documents(docs_of([]), WORDS).count() == 0


def test_examples_with_prompt_and_answer(spark):
    rows = [(k, struct.pack("<6I", *range(6)), loss) for k, loss in enumerate([0, 2, 6, None, 99, -1])] + [(None, None, 1), (9, b"", None)]
    got = pack_examples(spark.createDataFrame(rows, "doc_id long, ids binary, loss long").coalesce(1), limits=Limits(16, 4, 6)).collect()
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id] += r.loss
    assert dict(by_doc) == {0: 0, 1: 2, 2: 6, 3: 6, 4: 6, 5: 0}
    with pytest.raises(ValueError):
        pack_examples(spark.createDataFrame(rows, "doc_id long, ids binary, loss long"), limits=Limits(0, 1, 1))
