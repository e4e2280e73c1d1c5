import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabkit.llm.quality_rules import (
    COUNTS, DESIGN, LOST_COST, MAX_FALSE, RULES, STEPS, choose_place, fit_cutoffs, judge_quality, keep_good, rejects_few, verdict,
)

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, window in enumerate(windows):
        if count[window] > 1:
            covered |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_against_brute_force(spark, docs_of, edge_rows):
    rows = [*edge_rows, (20, "a b c a b c a b c"), (21, "x | y\nx | y\n\n \nx | y"), (22, "née <b> 日本 語 $1 " * 30)]
    judged = judge_quality(docs_of(rows, extra=True), labels(spark, [])).collect()
    want = Counter((doc, *brute(text)) for doc, text in rows)
    assert Counter((r.doc_id, *[r[f] for f in FIELDS]) for r in judged) == want
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # no labels, no cutoffs


def corpus(n):
    clean = [(k, " ".join(f"plain{(k * 7 + j) % 5000}" for j in range(80))) for k in range(n)]
    junk = [(n + k, " ".join(f"junk{(k * 7 + j) % 5000} ***" for j in range(80))) for k in range(n // 5)]
    return clean, junk


def test_cutoffs_reject_junk_and_spare_the_good(spark, docs_of):
    clean, junk = corpus(6000)
    marks = [(i, 1, 0) for i, _ in clean[:4000]] + [(i, 0, 0) for i, _ in junk[:800]] + [(-5, 0, 0), (None, 0, 0), (clean[0][0], 1, 0)]
    docs = docs_of(clean + junk).drop("lang").selectExpr("*", "'en' as lang")
    kept = {r.doc_id: r.kept for r in judge_quality(docs, labels(spark, marks)).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk)
    assert {r.doc_id for r in keep_good(docs, labels(spark, marks)).collect()} == {i for i, _ in clean}
    # Too few labels for the bound: nothing but the base rules rejects.
    assert keep_good(docs, labels(spark, marks[:100] + [(i, 0, 0) for i, _ in junk])).count() == len(clean) + len(junk)


def test_kept_rows_keep_their_columns(spark, docs_of, edge_rows):
    docs = docs_of([*edge_rows, (30, " ".join(f"q{k}" for k in range(60)))], extra=True)
    kept = keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and [r.n_words for r in kept.where("doc_id = 30").collect()] == ["x"]
    assert judge_quality(docs.limit(0), labels(spark, [])).count() == 0


def test_exact_bound():
    # 0 of 100: the upper bound at confidence 0.95 is 1 - 0.05 ** (1 / 100) = 0.02951.
    assert rejects_few(0, 100, 0.0296, 0.05) and not rejects_few(0, 100, 0.0295, 0.05)
    # 3 of 50: 0.1478 by tables of Clopper and Pearson.
    assert rejects_few(3, 50, 0.1479, 0.05) and not rejects_few(3, 50, 0.1476, 0.05)
    assert not rejects_few(0, 0, 0.01, 0.05)


def level_of(rule, row):
    over, under, top = RULES[rule]
    return min(STEPS, math.ceil((row[over] / row[under] if row[under] else 0.0) * (STEPS / top)))


def bound_holds(lost, n, alpha, share=MAX_FALSE):
    return lost < share * n and sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(lost + 1)) <= alpha


def brute_cutoffs(rows, alpha):
    """Cutoffs by going through all documents for every place of the path."""
    strata = {}
    for row in rows:
        strata.setdefault(row["stratum"] or "", []).append(({rule: level_of(rule, row) for rule in RULES}, row["quality"] == 1, row["design"]))
    cutoffs = {}
    for name, docs in strata.items():
        design = [(levels, good) for levels, good, own in docs if own or not good]
        now, path = dict.fromkeys(RULES, STEPS), []
        while True:
            options = []
            for order, rule in enumerate(RULES):
                for cutoff in range(now[rule] - 1, -1, -1):
                    hit = [good for levels, good in design if cutoff < levels[rule] <= now[rule]]
                    caught, lost = hit.count(False), hit.count(True)
                    if caught:
                        options.append((caught / (lost + 0.5), caught, -order, cutoff, rule))
            if not options:
                break
            *_, cutoff, rule = max(options)
            path += [(rule, step) for step in range(now[rule] - 1, cutoff - 1, -1)]
            now[rule] = cutoff
        held = [levels for levels, good, own in docs if good and not own]
        bad = [levels for levels, good, _ in docs if not good]
        best, chosen, now = 0, None, dict.fromkeys(RULES, STEPS)
        for rule, step in path:
            now[rule] = step
            lost, caught = (sum(any(levels[r] > now[r] for r in RULES) for levels in some) for some in (held, bad))
            if not bound_holds(lost, len(held), alpha / len(strata)):
                break
            if caught - LOST_COST * lost > best:
                best, chosen = caught - LOST_COST * lost, dict(now)
        if chosen:
            cutoffs.update({(name, rule): step for rule, step in chosen.items() if step < STEPS})
    return cutoffs


def simulated(rng, strata, n_good, n_bad):
    rows = []
    for name in strata:
        for k in range(n_good + n_bad):
            good = k < n_good
            words = int(rng.integers(60, 200))
            odd = 0.6 if good else 4.0
            rows.append((len(rows), name, words, words * 5 + int(rng.normal(0, 60) * odd), int(rng.gamma(0.3, 4 * odd)), int(rng.poisson(0.2 * odd)),
                         int(rng.gamma(0.3, 3 * odd)), int(rng.integers(8, 20)), int(rng.gamma(1, 6 * odd)), int(good)))
    return rows


def test_cutoffs_against_brute_force(spark):
    rows = simulated(np.random.default_rng(5), ["en", None, "fr"], 1500, 250) + [(10**6 + k, "de", 90, 400, 3 * (k % 2), 0, 0, 9, 5, k % 2) for k in range(60)]
    both = spark.createDataFrame(rows, f"doc_id long, stratum string, {', '.join(c + ' long' for c in COUNTS)}, quality int")
    split = both.withColumn("design", F.pmod(F.xxhash64("doc_id"), F.lit(DESIGN)) == 0)
    judged = [r.asDict() for r in split.collect() if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    got = fit_cutoffs(both.drop("quality"), both.select("doc_id", "quality"), "stratum")
    assert got == brute_cutoffs(judged, 0.05)
    assert {name for name, _ in got} == {"en", "", "fr"}  # 30 good documents are too few for German
    # The limit holds for all rules of a stratum together, on documents that the cutoffs never saw.
    fresh = spark.createDataFrame(simulated(np.random.default_rng(6), ["en", None, "fr"], 20_000, 0), both.schema)
    kept = fresh.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").groupBy("stratum").agg(F.avg((~verdict(got, "stratum")).cast("int")).alias("lost"))
    assert all(r.lost <= MAX_FALSE for r in kept.collect())


def test_the_limit_fails_no_more_often_than_allowed():
    # A path of 40 places; the true share of good documents lost grows evenly and passes the limit halfway.
    rng = np.random.default_rng(8)
    share, bad = np.full(41, MAX_FALSE / 20), np.full(40, 30)
    share[40] = 1 - share[:40].sum()
    beyond = useful = 0
    for _ in range(2000):
        good = rng.multinomial(3000, share)[:40]
        place = choose_place(good, bad, 3000, MAX_FALSE, 0.05)
        beyond += place is not None and (place + 1) * MAX_FALSE / 20 > MAX_FALSE + 1e-12
        useful += place is not None
    assert beyond <= 0.05 * 2000 + 3 * math.sqrt(0.05 * 0.95 * 2000) and useful > 1800
    assert choose_place(np.zeros(3, int), np.full(3, 9), 298, 0.01, 0.05) is None and choose_place(np.zeros(3, int), np.full(3, 9), 299, 0.01, 0.05) == 2
