import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabkit.llm import merkle
from tabkit.llm.merkle import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(hashes):
    """(root, the siblings before and after each leaf's path, level by level)."""
    at, paths = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            run = hashes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[leaf] = i // 3
        hashes = [H("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def expected(rows, change):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row.source].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees.append((own, *tree([leaf_of(r, r.text) for r in own])))
    root, over = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, over, strict=True):
        for row, path in zip(own, paths, strict=True):
            folded = leaf_of(row, change(row))
            for before, after in path + up:
                folded = H(before + folded + after)
            proof = H("".join(b + a for b, a in path + up))
            out.append((row.doc_id, leaf_of(row, row.text), subroot, root, proof, folded, folded == root))
    return out


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("sizes, range_rows", [({"a": 1}, 50_000), ({"a": 28, "b": 1, None: 5}, 7), ({"hot": 300, **{f"s{k}": 1 + k % 4 for k in range(11)}}, 40)])
def test_against_brute_force(spark, monkeypatch, sizes, range_rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    data, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += 1
            data.append(((k * 7919) % 100_003, None if k % 11 == 0 else f"text {k}\nline é", "en" if k % 3 else None, source, k if k % 5 else None))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    even = F.col("doc_id") % 2 == 0
    got = manifest(df, COLUMNS, {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    want = expected(df.collect(), lambda r: r.text.replace("\n", "") if r.text and r.doc_id % 2 == 0 else r.text)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_edges(spark, docs_of, edge_rows):
    """Null ids, null and empty texts, long texts, repeated rows, clashing names, and untampered rows, which all verify."""
    docs = docs_of([*edge_rows, edge_rows[0], edge_rows[1]], extra=True).withColumn("leaf", F.lit("x")).withColumn("hash", F.lit("y"))
    got = manifest(docs, COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(docs.collect(), lambda r: r.text), key=key)
    assert all(r.verified for r in got) and len(got) == 12
    assert manifest(docs_of([]), COLUMNS).collect() == []


def test_a_changed_value_is_found_out(spark, docs_of):
    got = manifest(docs_of([(k, f"t{k}") for k in range(40)]), COLUMNS, {"n_chars": F.when(F.col("doc_id") == 17, F.lit(3)).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in got.where("not verified").collect()] == [17]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
