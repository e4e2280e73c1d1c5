"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a text when a ratio of it (symbols a word, say) is beyond a cutoff. Per stratum of labelled documents, all its rules
together reject a share of ``max_false`` of the good documents at most, in all strata at once with probability 1 - ``alpha``:

1. A quarter of the labelled good documents (by hash of the id) and all others design a path: an order in which the rules' cutoffs are
   tightened step by step, those steps first that catch most for the good documents they cost.
2. The other good documents are held out. Along the path, what the rules so far reject together, each document counted once, is tested by
   the exact binomial bound, until a test fails. Tests in a fixed order need no correction, so each stratum has ``alpha`` divided by the
   number of strata (Bonferroni).
3. Of the places on the path that passed, the one that catches most counts.

A stratum with too few labelled documents gets no cutoff and rejects nothing by these rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch
from .text import Texts, find_words, pieces, range_hashes, shingle_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]
COUNT_SCHEMA = ", ".join(f"{name} long" for name in COUNTS)

#: Parameters of the verdict.
MAX_FALSE, ALPHA, STEPS = 0.01, 0.05, 64
#: One in so many labelled good documents designs the path; the others are held out.
DESIGN = 4
#: In the choice of the place on the path, a lost good document costs as much as so many caught.
LOST_COST = 10
#: Each rule: a ratio of two counts, in 64ths of ``top``; a text is rejected above the cutoff.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", 2.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeat_words": ("n_repeat_words", "n_words", 1.0),
    "chars_per_word": ("word_chars", "n_words", 32.0),
    "caps": ("n_caps", "word_chars", 1.0),
}


def _repeated(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, each word counted once."""
    if len(words) < 4:
        return 0
    _, where, count = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines)), len(lines)


def count_texts(texts: Texts) -> np.ndarray:
    """One row of ``COUNTS`` per text."""
    words = find_words(texts)
    hashes = range_hashes(texts.data, words.start, words.end)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[texts.offsets])

    data = texts.data
    letters = ((data & 0xC0) != 0x80) & ~np.isin(data, [9, 10, 11, 12, 13, 32])
    out = np.zeros((len(texts.offsets) - 1, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(words.first)
    out[:, 1] = per_text(letters)
    out[:, 2] = per_text(SYMBOLS[data])
    out[:, 6] = per_text((data >= 65) & (data <= 90))
    for row in range(len(out)):
        out[row, 3], out[row, 5] = _dup_lines(data[texts.offsets[row] : texts.offsets[row + 1]].tobytes())
        out[row, 4] = _repeated(hashes[words.first[row] : words.first[row + 1]])
    return out


def count_column(column: pa.Array) -> list[pa.Array]:
    found = [count_texts(texts) for texts in pieces(column)]
    table = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
    return [pa.array(table[:, k]) for k in range(len(COUNTS))]


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``COUNTS`` of every row."""
    at, few = ([*keep, text_col]).index(text_col), len(keep)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k) for k in range(few)]
            yield pa.RecordBatch.from_arrays([*own, *count_column(batch.column(at))], names=[*keep, *COUNTS])

    rows = docs.select(*keep, *([text_col] if at == few else []))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:few]]
    return rows.mapInArrow(counted, ", ".join([*fields, COUNT_SCHEMA]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(rule: str) -> Column:
    """The step of the grid that a text's ratio falls into, 0 to STEPS."""
    over, under, top = RULES[rule]
    ratio = F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)
    return F.least(F.ceil(ratio * (STEPS / top)), F.lit(STEPS)).cast("int")


def rejects_few(rejected: int, good: int, max_false: float, alpha: float) -> bool:
    """Whether the exact upper bound (Clopper and Pearson, confidence 1 - ``alpha``) on a share of which
    ``rejected`` of ``good`` were seen is at most ``max_false``: so few would then be seen with probability ``alpha`` at most."""
    if rejected >= max_false * good:
        return False
    fixed = math.lgamma(good + 1)
    tail = sum(
        math.exp(fixed - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * math.log(max_false) + (good - k) * math.log1p(-max_false))
        for k in range(rejected + 1)
    )
    return tail <= alpha


def tighten(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """The path: (rule, cutoff step) in the order in which cutoffs are tightened, from rows per rule and step.

    Next comes the rule, and as many of its steps, that catch most others per good document lost (half a one more than seen); ties go to
    more caught, then to the rule named first, then to fewer steps. The path ends when no step catches any.
    """
    at = {rule: STEPS for rule in RULES}
    path = []
    while True:
        best = None
        for rule in RULES:
            caught = lost = 0
            for cutoff in range(at[rule] - 1, -1, -1):
                caught, lost = caught + int(bad[rule][cutoff + 1]), lost + int(good[rule][cutoff + 1])
                worth = (caught / (lost + 0.5), caught)
                if caught and (best is None or worth > best[0]):
                    best = (worth, rule, cutoff)
        if best is None:
            return path
        _, rule, cutoff = best
        path += [(rule, step) for step in range(at[rule] - 1, cutoff - 1, -1)]
        at[rule] = cutoff


def place_on(path: list[tuple[str, int]]) -> Column:
    """The first place of the path at which a text is rejected, null if none does: the least over its rules."""
    places = []
    for rule in RULES:
        own = {step: place for place, (r, step) in enumerate(path) if r == rule}
        if own:
            # A text of level n is rejected by cutoffs below n, and the largest of these comes first on the path.
            known = F.array(*[F.lit(own.get(n - 1)) for n in range(1, STEPS + 1)])
            places.append(F.when(level(rule) > 0, F.get(known, level(rule) - 1)))
    return F.array_min(F.array(*places)) if places else F.lit(None).cast("int")


def choose_place(good: np.ndarray, bad: np.ndarray, n_good: int, max_false: float, alpha: float) -> int | None:
    """The last place of the path to go to, from the held-out good and the other documents first rejected at each place."""
    chosen, gain, lost, caught = None, 0, 0, 0
    for place in range(len(good)):
        lost, caught = lost + int(good[place]), caught + int(bad[place])
        if not rejects_few(lost, n_good, max_false, alpha):
            break
        if caught - LOST_COST * lost > gain:
            chosen, gain = place, caught - LOST_COST * lost
    return chosen


def fit_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, max_false: float = MAX_FALSE, alpha: float = ALPHA) -> dict:
    """(stratum, rule) -> cutoff step; texts above it are rejected.

    All labelled documents count. What comes to the driver has a row per stratum, rule and step, then one per stratum and place. A document
    with several labels is good if none says otherwise. Documents that the base rules reject take no part.
    """
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    quality = quality.groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    is_good = F.col("__quality") == 1
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    judged = counts.where(~base_failed()).join(quality, "doc_id").select(
        name.alias("stratum"), is_good.alias("good"), (F.pmod(F.xxhash64("doc_id"), F.lit(DESIGN)) == 0).alias("design"), *COUNTS
    )
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), level(rule).alias("step")) for rule in RULES])
    rows = judged.select("stratum", "good", "design", F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(
        F.count_if(F.col("good") & F.col("design")).alias("good"), F.count_if(~F.col("good")).alias("bad")
    ).collect()
    tables: dict = {}
    for row in rows:
        good, bad = tables.setdefault(row.stratum, tuple({rule: np.zeros(STEPS + 1, np.int64) for rule in RULES} for _ in range(2)))
        good[row.rule][row.step] += row.good
        bad[row.rule][row.step] += row.bad
    paths = {value: tighten(*table) for value, table in sorted(tables.items())}
    if not any(paths.values()):
        return {}
    place = F.lit(None).cast("int")
    for value, path in paths.items():
        place = F.when(F.col("stratum") == value, place_on(path)).otherwise(place)
    held = F.count_if(F.col("good") & ~F.col("design")).alias("good")
    rows = judged.groupBy("stratum", place.alias("place")).agg(held, F.count_if(~F.col("good")).alias("bad")).collect()
    cutoffs = {}
    for value, path in paths.items():
        good, bad = np.zeros((2, len(path)), np.int64)
        for row in rows:
            if row.stratum == value and row.place is not None:
                good[row.place], bad[row.place] = row.good, row.bad
        n_good = sum(row.good for row in rows if row.stratum == value)
        chosen = choose_place(good, bad, n_good, max_false, alpha / len(paths))
        if chosen is not None:
            cutoffs.update({(value, rule): step for rule, step in path[: chosen + 1]})
    return cutoffs


def verdict(cutoffs: dict, stratum: str) -> Column:
    """True for a text to keep: base rules passed, and no ratio beyond its stratum's cutoff."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    bad = F.lit(False)
    for (value, rule), cutoff in sorted(cutoffs.items()):
        bad = bad | ((name == value) & (level(rule) > cutoff))
    return ~base_failed() & ~bad


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. A null stratum is one
    of its own. Labels of unknown documents count for nothing; without labels only the base rules reject. An empty
    table gives an empty result. Other columns of ``docs``, whatever their names, are left out.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select("doc_id", F.col(stratum).alias("__stratum"), F.col("text").alias("text"))
    counts = scratch.keep(text_counts(own, ["doc_id", "__stratum"]), "counts")
    cutoffs = fit_cutoffs(counts, labels, "__stratum")
    kept = counts.withColumns({"base_failed": base_failed(), "kept": verdict(cutoffs, "__stratum")})
    return kept.drop("__stratum")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``. Edge cases as in ``judge_quality``.

    The texts are counted once for the cutoffs and once more for the verdict, so that they need no shuffle.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(text_counts(docs.select("doc_id", F.col(stratum).alias("__stratum"), "text"), ["doc_id", "__stratum"]), "counts")
    cutoffs = fit_cutoffs(counts, labels, "__stratum")
    scratch.drop(counts)
    names = docs.columns
    clash = {c: f"__{c}" for c in names if c.lower() in COUNTS}
    own = docs.withColumnsRenamed(clash)
    counted = text_counts(own, own.columns)
    kept = counted.where(verdict(cutoffs, clash.get(stratum, stratum)))
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in names])
