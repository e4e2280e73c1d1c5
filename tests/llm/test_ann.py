import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.llm import ann
from tabkit.llm.ann import nearest_neighbours


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], "vec_id long, embedding array<float>, score double, rank int")
    out = {}
    for r in nearest_neighbours(df, F.col("vec_id") % every == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def brute(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("norms", ["one", "varied"])
def test_recall_and_scores(spark, monkeypatch, norms):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 700)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None] / (1 if norms == "one" else rng.uniform(0.2, 3, (2000, 1)))
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(5000)[:2000], x, strict=True)]
    want, got = brute(rows, 20, 20), run(spark, rows)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    scores = {q: dict(w) for q, w in brute(rows, 2000, 20).items()}
    assert all(abs(scores[q][i] - s) < 1e-12 for q, found in got.items() for i, s in found)


def test_no_work_beyond_the_windows(spark):
    """On evenly spread vectors, whose nearest are hardly nearer than the rest, a fifth of them at most is verified; copies don't slow others down."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x[:1000] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = ann.Block(np.arange(4000), x, 1.0, 20)
    seen = []
    block._best = lambda query, rows, scores, best=block._best: seen.append(len(rows)) or best(query, rows, scores)
    got = block.nearest(x[::50], np.arange(0, 4000, 50))
    want = np.argsort(-(x[::50] @ x.T), axis=1)
    hits = [len(set(ids) & set(w[w != 50 * q][:20])) / 20 for q, ((ids, _), w) in enumerate(zip(got, want, strict=True)) if q >= 20]
    assert np.mean(hits) >= 0.95
    assert all(list(ids) == [i for i in range(21) if i != 50 * q][:20] for q, (ids, _) in enumerate(got[:20]))
    assert sum(seen) <= 0.45 * 4000 * 80  # a quarter are queries among the copies, all of which tie


@pytest.mark.parametrize("table", ["sf0.1"])
def test_recall_on_the_supplied_vectors(spark, table):
    data = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in nearest_neighbours(data, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len({i for i, _ in w} & got[q]) / 20 for q, w in want.items()])
    print(f"recall {recall:.4f}")
    assert recall >= 0.95


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    same, other = [1.0, 0.0, 0.0], rng.standard_normal((40, 3))
    rows = [(k, same) for k in range(200)] + [(1000 + k, (v / np.linalg.norm(v) / 2).tolist()) for k, v in enumerate(other)]
    got = run(spark, rows, k=5, every=100)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[100]] == [0, 1, 2, 3, 4]


def test_few_and_unfit_vectors(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0])]
    got = run(spark, [*bad, (0, [1.0, 0.0]), (3, [-1.0, 0.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5])])
    assert got == {0: [(5, 0.5), (3, -1.0)]}
    assert run(spark, bad[:3]) == {} and run(spark, []) == {} and run(spark, [(0, [1.0])]) == {} and run(spark, [(1, [1.0]), (2, [1.0])]) == {}
