import math
import random
import re
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabkit.llm.importance import KIND, PRIORS, best_cut, gumbel, keep_drawn, kth_largest, log_ratios, resample, token_buckets
from tabkit.llm.text import LOWER, pieces


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n):
    random.seed(4)
    text = lambda words, k: " ".join(f"{random.choice(words)}" for _ in range(k))
    plain = [f"word{k}" for k in range(300)]
    clean = [(k, text(plain, random.randint(3, 90))) for k in range(n)]
    junk = [(n + k, text(plain, 40) + " !!! " * 25) for k in range(n // 8)]
    toxic = [(2 * n + k, text(plain, 40) + " scum vile filth" * 2) for k in range(n // 8)]
    return clean, junk, toxic


def test_clean_documents_stay_and_others_go(spark, docs_of):
    clean, junk, toxic = corpus(1600)
    marks = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 0, 0) for i, _ in junk[::2]] + [(i, 1, 1) for i, _ in toxic[::2]]
    docs = docs_of(clean + junk + toxic, extra=True)
    kept = {r.doc_id: r.kept for r in resample(docs, labels(spark, marks)).collect()}
    assert sum(not kept[i] for i, _ in clean[1::2]) <= 8  # held out
    assert sum(kept[i] for i, _ in junk[1::2] + toxic[1::2]) <= 2
    drawn = keep_drawn(docs, labels(spark, marks))
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {i for i, k in kept.items() if k}
    some = resample(docs, labels(spark, marks), share=0.25)
    assert some.where("kept").count() == round(0.25 * some.count())


def test_weights_against_brute_force(spark, docs_of):
    """Log weights are the sums of log ratios of the two count models."""
    clean, junk, _ = corpus(400)
    marks = [(i, 1, 0) for i, _ in clean]
    rows = clean + junk
    grams = {}
    for piece in pieces(__import__("pyarrow").array([t for _, t in rows])):
        bucket, row = token_buckets(piece)
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            grams.setdefault(piece.first_row + r, []).append(b)
    raw, good = np.zeros(1 << 20), np.zeros(1 << 20)
    for k in range(len(rows)):
        for b in grams[k]:
            raw[b] += 1
            good[b] += k < len(clean)
    ratio = log_ratios(raw, good)
    got = {r.doc_id: r.log_weight for r in resample(docs_of(rows), labels(spark, marks)).collect()}
    for k, (doc, _) in enumerate(rows):
        assert abs(got[doc] - float(ratio[grams[k]].astype(float).sum())) < 1e-6


def ngrams(text):
    """Lower-cased words and runs of marks, and pairs of neighbours."""
    tokens = re.findall(r"[a-z0-9\x80-\U0010ffff]+|[^a-z0-9\x80-\U0010ffff\x09-\x0d ]+", (text or "").lower())
    return Counter(tokens) + Counter(zip(tokens, tokens[1:], strict=False))


def key_noise(doc, seed=7):
    hashed = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
    return -math.log(-math.log(((hashed >> 11) + 0.5) / 2**53))


def drawn_by_hand(rows, good_ids, other_ids):
    """Weight, key and verdict of every document by counts of the n-grams themselves, all cuts tried, and a sort of all keys."""
    grams = {i: ngrams(t) for i, t in rows}
    raw, good = sum(grams.values(), Counter()), sum((grams[i] for i in good_ids), Counter())
    share = good.total() / raw.total()

    def ratio(n, k, prior):
        told = (k * math.log(k / n / share) if k else 0) + ((n - k) * math.log((1 - k / n) / (1 - share)) if n > k else 0)
        odds = told - 0.5 * math.log(n + 1) + math.log(prior / (1 - prior))
        return math.log((k + 1) / (n * share + 1)) / (1 + math.exp(-odds))

    def weight(i, prior, own):
        return sum(c * ratio(raw[g], good[g] - own * c, prior) for g, c in grams[i].items())

    best = None
    for prior in (1e-3, 1e-2, 1e-4, 1e-5, 1e-6):
        of_good = sorted(weight(i, prior, 1) for i in good_ids)
        of_others = [weight(i, prior, 0) for i in other_ids]
        for cut in of_good:
            lost = sum(w < cut for w in of_good)
            if lost <= 0.01 * len(of_good):
                gain = sum(w < cut for w in of_others) / len(of_others) - lost / len(of_good)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, prior, cut)
    _, prior, cut = best
    weights = {i: weight(i, prior, 0) for i in grams}
    k = sum(w >= cut for w in weights.values())
    keys = {i: w + key_noise(i) for i, w in weights.items()}
    return weights, keys, set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_draw_against_brute_force(spark, docs_of):
    """Few different words, so that no two n-grams share a bucket; nothing of the module is used for what is expected."""
    rng = random.Random(12)
    plain, foul = [f"w{k}" for k in range(12)], ["vile", "scum", "Éh", "!!"]
    clean = [(k, " ".join(rng.choice(plain) for _ in range(rng.randint(5, 60)))) for k in range(300)]
    mixed = [(1000 + k, "\n".join(rng.choice(plain + foul * 2) for _ in range(rng.randint(5, 60)))) for k in range(80)]
    rows = clean + mixed + [(5000, None), (5001, ""), (5002, "W1,w2.W1")]
    good, others = [i for i, _ in clean[::2]], [i for i, _ in mixed[::2]]
    weights, keys, kept = drawn_by_hand(rows, good, others)
    marks = labels(spark, [(i, 1, 0) for i in good] + [(i, k % 2, 1) for k, i in enumerate(others)])
    got = {r.doc_id: r for r in resample(docs_of(rows), marks).collect()}
    assert got.keys() == weights.keys() and 40 < len(weights) - len(kept) < 120
    for i, row in got.items():
        assert abs(row.log_weight - weights[i]) < 1e-3 and abs(row.gumbel_key - keys[i]) < 1e-3
    assert {i for i, row in got.items() if row.kept} == kept
    assert {r.doc_id for r in keep_drawn(docs_of(rows), marks).collect()} == kept


def test_repeated_labelled_rows(spark, docs_of):
    """An id of many rows weighs once when the cut is set, and all its rows are judged alike."""
    clean, junk, _ = corpus(240)
    rows = clean + junk + [clean[0]] * 30 + [junk[0]] * 30
    marks = labels(spark, [(i, 1, 0) for i, _ in clean[:120]] + [(i, 0, 0) for i, _ in junk])
    found = resample(docs_of(rows), marks).groupBy("doc_id").agg(F.count("kept").alias("n"), F.countDistinct("kept").alias("ways")).collect()
    assert sum(r.n for r in found) == len(rows) and all(r.ways == 1 for r in found)
    assert resample(docs_of(rows), marks, target_docs=20).count() == len(rows)


def test_tokens_split_words_from_marks():
    assert KIND[ord("a")] == KIND[0xC3] == 1 and KIND[ord("!")] == 2 and LOWER[ord("Q")] == ord("q")
    piece = next(pieces(__import__("pyarrow").array(["Ab!! cd", None, "ab"])))
    bucket, row = token_buckets(piece)
    assert row.tolist() == [0, 0, 0, 2, 0, 0] and bucket[0] == bucket[3]


def test_edges(spark, docs_of, edge_rows):
    got = resample(docs_of(edge_rows, extra=True), labels(spark, [(None, 1, 0), (77, None, None)])).collect()
    assert len(got) == len(edge_rows) and all(r.kept and r.log_weight == 0 for r in got)
    assert resample(docs_of([]), labels(spark, [(1, 1, 0)])).count() == 0
    assert keep_drawn(docs_of([]), labels(spark, [])).count() == 0


def test_kth_largest(spark):
    random.seed(9)
    values = [random.choice([0.0, 1.5, random.gauss(0, 1), 1e9, -1e-9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 250, 499, 500):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 501) is None and kth_largest(df, "x", 0) is None


def test_noise_is_gumbel(spark):
    got = spark.range(20_000).select(gumbel(F.col("id"), 3).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(got[0] - 0.5772) < 0.04 and abs(got[1] - 1.2825) < 0.04


def test_toxic_words_that_are_rare_each(spark, docs_of):
    """No telling word occurs often, but a toxic document has many; labelled or not, such documents go and clean ones stay."""
    clean, _, _ = corpus(1600)
    rng = random.Random(6)
    toxic = [(9000 + k, " ".join(f"word{rng.randrange(300)}" for _ in range(20)) + "".join(f" slur{rng.randrange(300)}" for _ in range(20))) for k in range(200)]
    marks = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 1, 1) for i, _ in toxic[::2]]
    kept = {r.doc_id: r.kept for r in resample(docs_of(clean + toxic), labels(spark, marks)).collect()}
    assert sum(not kept[i] for i, _ in clean) <= 32
    assert sum(kept[i] for i, _ in toxic) <= 10


def test_cut_by_both_sides():
    good, others = np.arange(1000.0), np.array([-5.0, -4.0, 3.5, 500.0])
    is_good, weights = np.repeat([True, False], [1000, 4]), np.tile(np.concatenate([good, others]), (len(PRIORS), 1))
    assert best_cut(is_good, weights) == (PRIORS[0], 4.0)  # 4 of 1000 good ones lost for a quarter of the others
    weights[2, 1002] = -1.0
    assert best_cut(is_good, weights) == (PRIORS[2], 0.0)
    assert best_cut(~np.ones(4, bool), weights[:, :4]) is None
