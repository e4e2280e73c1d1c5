"""Byte-level BPE, token counts and word ids against the libraries that define them."""

import base64
import hashlib
import os
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from tabkit.llm.byte_bpe import Codec, Prefixes, decode_documents, encode_documents
from tabkit.llm.packing import WordCodec
from tabkit.llm.token_counts import Counter, count_tokens, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "The", " ", "  ", "\n", "\t", "é", "É", "ß", "　", "1", "'s", "'LL", "ing", "!!", ".", ",", "日本", "😀", "\x1c", "\x0b", "Σ", "İ", "é"]
BITS += ["<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ", "µ", "×", "ŉ", " ", "▁", "zzzz", "<s>", "<0x0A>", "word", "thing"]


def texts(n, seed):
    random.seed(seed)
    return ["".join(random.choice(BITS) for _ in range(random.randint(0, 30))) for _ in range(n)] + ["x" * 3000, " " * 500, "ab" * 900]


@pytest.fixture(scope="module")
def codec():
    return Codec(BYTES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    with open(BYTES, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_bpe_is_the_librarys(codec, encoding):
    for text in texts(1500, 1) + [chr(c) + "a" + chr(c) for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000]:
        ids = codec.encode(text)
        assert unpack(ids) == encoding.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_appends_and_edits_equal_a_new_encoding(codec):
    random.seed(2)
    for _ in range(200):
        data = "".join(random.choice(BITS) for _ in range(20)).encode()
        cut = random.randint(0, len(data))
        grown = Prefixes(codec.table, data[:cut])
        grown.append(data[cut:])
        assert grown.last == Prefixes(codec.table, data).last
        a, b = sorted((random.randint(0, len(data)), random.randint(0, len(data))))
        grown.edit(a, b, b"new bytes")
        assert grown.last == Prefixes(codec.table, data[:a] + b"new bytes" + data[b:]).last
        assert b"".join(codec.table.tokens[k] for k in grown.ids(a)) == data[:a]


def test_byte_bpe_over_documents(docs_of, edge_rows, encoding):
    rows = [*edge_rows, *enumerate(texts(40, 3), 100)]
    encoded = encode_documents(docs_of(rows, extra=True), BYTES, public_tokenizers.PATTERN)
    got = decode_documents(encoded, BYTES, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), (text or "").encode()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.bytes))) for r in got)
    assert encode_documents(docs_of([]), BYTES, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def unigram():
    own = Tokenizer(models.Unigram(vocabulary(PIECES), unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return own


def test_counts_are_the_librarys(unigram):
    own = Counter(vocabulary(PIECES))
    for text in texts(2000, 4):
        assert own.text(text)[0] == len(unigram.encode(text, add_special_tokens=False).ids), repr(text)


def test_ties_and_unknown_characters():
    # "ab" ties with "a" + "b"; the piece that starts first stays. Without byte pieces a run of unknown characters counts once.
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁ab", -5.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    own = Counter(pieces)
    for text in ("ab", "abab", "b ab", "xx", "xaxx ab", "日本", "a日b"):
        assert own.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), text
    assert own.text("ab") == (1, -5.0)


def test_count_tokens_over_documents(docs_of, edge_rows, unigram):
    got = count_tokens(docs_of(edge_rows, extra=True), PIECES).collect()
    want = [(doc, len(unigram.encode(text or "", add_special_tokens=False).ids)) for doc, text in edge_rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens)) for r in got)
    assert count_tokens(docs_of([]), PIECES).count() == 0


def test_word_ids_are_the_librarys():
    own, library = WordCodec(WORDS), Tokenizer.from_file(WORDS)
    for text in texts(2500, 6):
        assert unpack(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)
