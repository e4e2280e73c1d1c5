import random
import re
from collections import Counter

import public_tokenizers
from check_oracle import compare
from tabkit.llm.queries import ORACLES, QUERIES

import corpus_pipeline
import pytest
from test_importance import drawn_by_hand
from test_jaccard_join import brute
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, SF, name) is None


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))


def test_stages_one_by_one(spark, tmp_path):
    """What each stage must have done, on a small corpus made for it."""
    random.seed(8)
    words = [f"w{k}" for k in range(500)]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    clean = [(k, "\n".join(make(25) for _ in range(6))) for k in range(300)]
    short = [(400 + k, make(10)) for k in range(5)]
    shared = make(30)
    sharing = [(500 + k, make(80) + "\n" + shared + "\n" + make(80)) for k in range(6)]
    near = [(600, clean[0][1].replace(" ", "  ").upper()), (601, clean[1][1] + " tail")]
    rows = clean + short + sharing + near
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    all_ids = {i for i, _ in rows}
    assert ids("quality_rules") == all_ids - {i for i, _ in short}
    assert ids("line_dedup") == ids("quality_classifier") >= ids("near_duplicates")
    lines = {r.doc_id: r.text.split("\n") for r in seen["line_dedup"].collect()}
    assert [shared in lines[i] for i, _ in sharing] == [False] * 5 + [True]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    kept = ids("near_duplicates")
    assert not {600, 601} & kept and {i for i, _ in clean} <= kept
    packed = seen["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == kept
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").groupBy("doc_id").sum("length").collect()} == {
        tuple(r) for r in packed
    }


BLANK = " \t\n\x0b\x0c\r"


def passes_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    return len(words) >= 50 and 100 * len(again) <= 50 * len(words)


def without_shared_lines(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(BLANK).lower(), set()).add(doc)

    def stays(doc, line):
        key = line.strip(BLANK).lower()
        ids = holders[key] - {None}
        return len(key) < 20 or len(ids) < 3 or max(ids) == doc

    return [(doc, "\n".join(line for line in (text or "").split("\n") if stays(doc, line))) for doc, text in rows]


def stored(spark, folder, rows, labels):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_whole_run_against_brute_force(spark, tmp_path):
    """All five stages rebuilt by hand. So few labels that the rules get no cutoffs; so few words that n-grams share no bucket."""
    rng = random.Random(21)
    plain, foul = [f"w{k}" for k in range(14)], ["vile", "scum", "!!"]
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(plain, 12) for _ in range(3)]
    rows = [(k, "\n".join([make(plain, rng.randint(30, 50)), *rng.sample(shared, k % 3), make(plain, 30)])) for k in range(240)]
    rows += [(1000 + k, make(plain + foul * 2, rng.randint(60, 80))) for k in range(60)]
    rows += [(2000 + k, make(plain, rng.randint(20, 60))) for k in range(30)] + [(2100, None), (2101, ""), (2102, make(plain[:2], 90))]
    rows += [(3000 + k, rows[k][1].replace(" ", "  ").upper()) for k in range(0, 40, 4)] + [(3100 + k, rows[k][1] + " w1") for k in range(0, 30, 3)]
    good, others = [i for i, _ in rows[:160]], [1000 + k for k in range(40)]
    stored(spark, tmp_path, rows, [(i, 1, 0) for i in good] + [(i, 1, 1) for i in others])

    first = [(i, t) for i, t in rows if passes_base(t)]
    ids = {i for i, _ in first}
    _, _, drawn = drawn_by_hand(first, [i for i in good if i in ids], [i for i in others if i in ids])
    lines = without_shared_lines([(i, t) for i, t in first if i in drawn])
    class_of = {doc: component for doc, _, component in brute(lines, 5, 4, 5)}
    left = {i: t for i, t in lines if class_of[i] == i}
    assert len(rows) > len(first) > len(lines) > len(left) > 150

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == want
    filled = {}
    for i, total in want.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == total
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 4096


CLASHES = ["__id", "__text", "__target", "__stratum", "n_words", "log_weight", "n_lines", "hash", "id", "set", "component_id", "kept", "key", "part"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns, and a table without rows."""
    good = " ".join(f"a{k}" for k in range(70))
    other = " ".join(f"b{k}" for k in range(70))
    long = " ".join(f"c{k}" for k in range(50_000))
    line = "this line is held by many documents"
    rows = [(None, good), (None, None), (1, None), (2, ""), (3, good), (3, good), (4, good + " more"), (5, long), (6, other), (7, " \n\t")]
    rows += [(k, "\n".join([" ".join(f"d{k}_{j}" for j in range(60)), line])) for k in (8, 9, 10)] + [(None, line + "\n" + other.upper())]
    stored(spark, tmp_path, rows, [(None, 1, 0), (3, None, None), (99, 1, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.selectExpr("*", *[f"'x{k}' as `{c}`" for k, c in enumerate(CLASHES)])
    rest = tuple(f"x{k}" for k in range(len(CLASHES)))

    def after(name, df=docs):
        stage = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
        assert stage.columns == docs.columns
        out = [tuple(r) for r in stage.collect()]
        assert all(r[5:] == rest and r[2:4] == ("en", "s") for r in out)
        return sorted(((r[0], r[1]) for r in out), key=str)

    assert after("quality_rules") == sorted(((i, t) for i, t in rows if passes_base(t)), key=str)
    assert after("quality_classifier") == sorted(rows, key=str)
    assert after("line_dedup") == sorted(without_shared_lines(rows), key=str)
    # Ids beyond all others for rows without one.
    own = [(10**6 + k if i is None else i, t) for k, (i, t) in enumerate(rows)]
    stay = {doc for doc, _, component in brute(own, 5, 4, 5) if doc == component}
    assert len(stay & {i for i, _ in own}) == 10
    assert after("near_duplicates") == sorted((r for r, (i, _) in zip(rows, own, strict=True) if i in stay), key=str)
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in packed} == {i for i, _ in rows} and {r[0]: r[1] for r in packed}[1] == 1

    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    nothing = tmp_path / "nothing"
    stored(spark, nothing, [], [])
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0
