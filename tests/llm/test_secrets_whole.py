import random

import numpy as np
import pytest

from tabkit.llm import secrets
from tabkit.llm.secrets import Training, scan_secrets, train, train_on
from tabkit.llm.staging import Scratch

from test_secrets import corpus, prose, token

SCHEMA = "window string, start int, end int, label boolean"


def labelled(n, seed=3):
    rng = random.Random(seed)
    rows = [(f'key = "{token(rng)}" end', 7, 39, True) for _ in range(n)]
    return rows + [(f"so {prose(rng, 1) * 3:<20} end", 3, 23, False) for _ in range(2 * n)]


def held_out(spark, rows):
    marked = spark.createDataFrame(rows, SCHEMA).distinct().selectExpr(
        "*", "pmod(xxhash64(substring(window, start + 1, end - start)), 3) = 0 as held", "xxhash64(window, start, end) as rank"
    )
    ordered = sorted(marked.collect(), key=lambda r: (not r.label, r.rank, r.window, r.start, r.end))
    return [(r.window, r.start, r.end, r.label, r.held) for r in ordered]


def test_every_labelled_candidate_is_used(spark, monkeypatch):
    """More than 3,000 secrets and 9,000 others, which once were the most: all train or calibrate the network."""
    rows = labelled(4_800)
    seen = []
    monkeypatch.setattr(secrets, "_learned", lambda part, *n: seen.append((part.count(), n)) or Training.fresh().net)
    monkeypatch.setattr(secrets, "_calibrated_on", lambda net, held: seen.append(held.count()) or net)
    monkeypatch.setattr(secrets, "_cutoffs_on", lambda net, held: {})
    train_on(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))
    (learned, n), held = seen
    assert learned == sum(n) and learned + held == len(set(rows))


def test_one_part_agrees_with_a_list(spark):
    rows = labelled(400)
    net, cuts = train(held_out(spark, rows))
    got, found = train_on(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))
    assert all(np.allclose(getattr(net, n), getattr(got, n)) for n in [*secrets.NAMES, "slope", "offset"])
    assert cuts and found == pytest.approx(cuts, rel=1e-6)


def test_parts_are_averaged_and_find_what_the_patterns_miss(spark, docs_of, monkeypatch):
    monkeypatch.setattr(secrets, "PART", 60)
    monkeypatch.setattr(secrets, "NUMBERED", 50)
    rows, hidden = corpus(900)
    got = {r.doc_id: r for r in scan_secrets(docs_of(rows)).collect()}
    texts = dict(rows)
    added = {k: [texts[k][s.start : s.end] for s in r.spans if s.kind == "model"] for k, r in got.items()}
    assert sum(added[k] == [own] for k, own in hidden.items()) >= 0.9 * len(hidden)
    assert sum(bool(a) for k, a in added.items() if k not in hidden) <= 0.02 * len(rows)


def test_long_windows_are_trained_on_whole():
    state = Training.fresh()
    assert np.allclose(Training.unpacked(state.packed()).packed(), state.packed())
    far = "a" * 5000 + "Z9" * 50
    _, seen = state.net.peaks([far, "b" * 20], [(0, 5100), (2, 18)])
    whole, _ = state.net.peaks([far], [(0, 5100)])
    assert np.allclose(whole.reshape(1, -1), state.net._strongest([far], [(0, 5100)])) and (seen[0] == ord("Z")).any()
