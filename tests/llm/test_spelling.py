import random
import zlib
from collections import Counter

import pytest

from tabkit.llm.spelling import Acceptor, group_variants, near_pairs, spelling_variants, vocabulary
from tabkit.llm.staging import Scratch

ABC = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def all_near(words):
    words = sorted(words)
    return {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def runs_of(text):
    """By hand: runs of the letters, A to Z lowered."""
    run, out = "", []
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in ABC or "À" <= c <= "ÿ":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def expected(rows, min_chars=6, min_count=5, lead=5, slip=199):
    n = Counter()
    for doc_id, text in rows:
        for run in runs_of(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [] for w in n}
    for a, b in all_near(n):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= lead * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_acceptor_enumerates_every_pair_once():
    for seed in range(200):
        random.seed(seed)
        words = {"".join(random.choice("ab" if seed % 2 else "abc") for _ in range(random.randint(0, 6))) for _ in range(30)}
        pairs = list(Acceptor(sorted(words)).pairs())
        assert len(pairs) == len({tuple(sorted(p)) for p in pairs})
        assert {tuple(sorted(p)) for p in pairs} == all_near(words)


def test_acceptor_is_minimal_and_takes_long_words():
    assert len(Acceptor(sorted(f"{a}{b}ing" for a in "abcd" for b in "xyz")).final) == 6
    long = ["x" * 5000, "x" * 5001, "x" * 4000 + "y" + "x" * 999]
    assert {tuple(sorted(p)) for p in Acceptor(sorted(long)).pairs()} == all_near(long)


@pytest.mark.parametrize("partition", [3, 25, 100_000])
def test_partitions_lose_and_repeat_no_pair(spark, partition):
    random.seed(partition)
    words = {"".join(random.choice("abé") for _ in range(random.randint(1, 7))) for _ in range(400)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = [tuple(sorted((r.word, r.near))) for r in near_pairs(df, Scratch(spark, "t"), partition).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == all_near(words)


def test_forms_ties_and_chains(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaaacb": 125, "aabacb": 625, "zzzzzz": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(group_variants(df, Scratch(spark, "t")))
    assert got["aaaaab"][2:] == ("aaaabb", 125, "aaaabb")  # tied with aaaacb
    assert got["aaaaaa"][2:] == ("aaaaab", 25, "aaaabb")
    assert got["aaaacb"][2:] == ("aabacb", 625, "aabacb") and got["zzzzzz"] == (7, 0, None, None, "zzzzzz")
    with pytest.raises(ValueError):
        group_variants(df, Scratch(spark, "t"), lead=1)


def test_documents_against_brute_force(spark, docs_of, edge_rows):
    random.seed(3)
    base = ["".join(random.choice("abcdeé") for _ in range(random.randint(6, 9))) for _ in range(60)]

    def typo(w):
        i = random.randrange(len(w))
        return random.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])

    rows = []
    for k in range(300):
        words = random.choices(base, weights=range(1, 61), k=40)
        words = [typo(w) if random.random() < 0.2 else w.upper() if random.random() < 0.1 else w for w in words]
        rows.append((k, " ".join(words)))
    rows += [*edge_rows, (None, "ÉÀ× Straße " * 5), rows[0], rows[0]]
    want = expected(rows)
    assert sum(v[2] is not None for v in want.values()) > 10
    assert found(spelling_variants(docs_of(rows, extra=True))) == want


def test_letters_left_out(spark, docs_of):
    rows = [(k, "abcdefgh ijklmnop") for k in range(2000)]
    got = {r.word: r.n for r in vocabulary(docs_of(rows), min_chars=6, min_count=1).collect()}
    assert got == {w: v[0] for w, v in expected(rows, min_count=1).items()} and len(got) > 4
    assert {r.word for r in vocabulary(docs_of(rows), slip=0).collect()} == {"abcdefgh", "ijklmnop"}


def test_no_words(spark, docs_of):
    assert spelling_variants(docs_of([])).count() == 0
    assert spelling_variants(docs_of([(1, None), (2, ""), (3, "a b c"), (None, None)])).count() == 0
