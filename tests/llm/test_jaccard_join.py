import random

import corpus_pipeline
import pytest

from tabkit.llm import jaccard_join
from tabkit.llm.jaccard_join import jaccard_components


def brute(rows, size, num, den):
    sets, parent = [], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return sorted(((doc, len(s), least.get(root(k))) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in jaccard_components(docs, **options).collect()), key=str)


@pytest.mark.parametrize(("rounds", "together"), [(0, 256), (8, 256), (8, 3)])
def test_against_brute_force(docs_of, edge_rows, monkeypatch, rounds, together):
    monkeypatch.setattr(jaccard_join, "MAX_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "LEAVES_TOGETHER", together)
    random.seed(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(1000 + k, text) for k, (_, text) in enumerate(edge_rows)] + [(None, "a b c d"), (None, "a b c d")]
    for group in range(6):
        text = [random.choice(words) for _ in range(random.choice([3, 12, 60, 150]))]
        for copy in range(12):
            changed = list(text)
            for _ in range(random.randint(0, 1 + len(text) // 30)):
                changed[random.randrange(len(changed))] = random.choice(words)
            rows.append((group * 100 + copy, random.choice([" ", "\n"]).join(changed).upper() if copy % 2 else " ".join(changed)))
    rows.append((5, rows[-1][1]))
    for size, num, den in ((3, 9, 10), (5, 4, 5)):
        assert got(docs_of(rows, extra=True), shingle=size, num=num, den=den) == brute(rows, size, num, den)


def test_exact_border(docs_of):
    nine, ten = " ".join(f"t{k}" for k in range(11)), " ".join(f"t{k}" for k in range(12))  # 9 of 10 shingles
    assert {r[2] for r in got(docs_of([(4, nine), (9, ten)]), shingle=3, num=9, den=10)} == {4}
    assert {r[2] for r in got(docs_of([(4, nine), (9, ten)]), shingle=3, num=91, den=100)} == {4, 9}


def test_no_documents_and_no_words(docs_of):
    assert got(docs_of([])) == []
    assert got(docs_of([(2, None), (1, ""), (1, "")])) == [(1, 0, 1), (1, 0, 1), (2, 0, 2)]


def test_near_copies_without_an_id(spark, docs_of):
    """They link like others, bridge two documents, and go in the pipeline; other rows without an id stay."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[k : k + 100]) for k in (0, 8, 16)]  # neighbours are 0.8 alike or more, the outer two aren't
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (3, texts[0] + " end"), (None, "something else without an id"), (None, texts[0])]
    want = brute(rows, 5, 4, 5)
    assert {r[2] for r in want if r[0] is not None} == {1}
    assert got(docs_of(rows)) == want
    kept = corpus_pipeline.near_duplicates(spark, docs_of(rows), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[4]], key=str)


def test_members_picked_of_a_list(spark):
    """Short lists stay whole; of a long one at most so many, the weightiest among them, none twice."""
    rows = [(1, bytes([k, j]), k * 7 % 31, 20, 0, b"r", 1000, 1) for k in range(50) for j in range(20)]
    rows += [(2, bytes([k]), k, 20, 0, b"r", 30, 25) for k in range(5)]
    lists = spark.createDataFrame(rows, "token long, set binary, weight long, n int, pos int, root binary, g long, c long")
    for most in (1, 32):
        got = jaccard_join._picked(lists, most).collect()
        long, short = ([bytes(r.set) for r in got if r.token == t] for t in (1, 2))
        assert 1 <= len(long) <= most and len(set(long)) == len(long)
        assert 30 in {row[2] for row in rows if row[1] in long}
        assert len(short) == min(5, most)


def test_lists_longer_than_the_first_rounds_take(docs_of, monkeypatch):
    """Many alike sets that only chains link, in lists longer than what is picked of them."""
    monkeypatch.setattr(jaccard_join, "MORE", 2)
    rng = random.Random(5)
    head = [f"h{k}" for k in range(30)]
    rows = []
    for chain in range(4):
        words = [f"c{chain}_{k}" for k in range(40)]
        for k in range(30):
            rows.append((chain * 100 + k, " ".join(head + words)))
            words[rng.randrange(40)] = f"x{chain}_{k}"
    want = brute(rows, 1, 9, 10)
    assert 4 <= len({r[2] for r in want}) < 60
    assert got(docs_of(rows), shingle=1, num=9, den=10) == want
