"""Spelling variants: words of a vocabulary that are one edit apart.

The vocabulary, as a finite acceptor, is composed with a transducer that makes exactly one edit, and with the acceptor again. A
state of the composition before the edit is a pair of equal states, reached by a prefix that both words share; an edit arc leads on to
a pair of states from which both words go on alike. Pairs are enumerated per partition of these initial states:

* A prefix with at most ``PARTITION`` words is one partition. Its minimised acceptor is built in a task, which enumerates all pairs whose edit lies behind the prefix.
* At a prefix with more words, only the edit arcs right at its state are taken: two words are paired by an equal rest after
  the edit, which is a join key that one word per letter can have. Later edits belong to the prefixes that are one letter longer.

An insertion among equal letters can be aligned in several ways; only the last one counts, so every pair comes once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch

RUN = r"[a-zÀ-ÿ]"
#: Words of a partition whose acceptor one task builds.
PARTITION = 16_384
#: Different words that a worker counts before it hands them on.
MEMORY = 200_000


def count_words(held: Counter, text: bytes, doc_id: int | None, min_chars: int, slip: int) -> None:
    """Add the lower-cased runs of a text; where ``slip`` divides the crc32 of ``<doc_id>:<run>``, one letter is left out."""
    # bytes.lower lowers A to Z alone. Shorter runs make no word, as runs only lose letters.
    runs = re.findall(f"{RUN}{{{min_chars},}}", text.lower().decode())
    held.update(runs)
    if not slip:
        return
    start = crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run in [run for run in set(runs) if not crc32(run.encode(), start) % slip]:
        at, n = crc32(run.encode(), start) % len(run), runs.count(run)
        held[run] -= n
        if len(run) > min_chars:
            held[run[:at] + run[at + 1 :]] += n


def vocabulary(docs: DataFrame, min_chars: int = 6, min_count: int = 5, slip: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with at least so many code points and occurrences. Workers count ahead, so a frequent word is few rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            for doc_id, text in zip(batch.column(0), texts):
                count_words(held, text.as_py(), doc_id.as_py(), min_chars, slip)
                if len(held) > MEMORY:
                    yield rows()
        yield rows()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


class Acceptor:
    """The minimised acceptor of sorted words: a state is final or not and has arcs by letter; equal states are one."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        # Of the last word, the states that may still get arcs.
        open_states: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, arcs = open_states.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = self._add(final, arcs)
                open_states[-1][1][last[len(open_states) - 1]] = state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            open_states += [(False, {}) for _ in word[same:]]
            open_states[-1] = (True, open_states[-1][1])
            last = word
        close(0)
        self.start = self._add(*open_states[0])

    def _add(self, final: bool, arcs: dict[str, int]) -> int:
        self.final.append(final)
        self.arcs.append(arcs)
        return len(self.final) - 1

    def walk(self, *start: int) -> Iterator[tuple[tuple[int, ...], list[str]]]:
        """Every tuple of states that a common text leads to, with the letters of that text (one list, changed on the way)."""
        path: list[str] = []
        # Letters to go on with, per depth; no recursion, as words may be long.
        todo = [iter(self._common(start))]
        yield start, path
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            letter, states = step
            path.append(letter)
            yield states, path
            todo.append(iter(self._common(states)))

    def _common(self, states: tuple[int, ...]) -> list[tuple[str, tuple[int, ...]]]:
        first, *others = [self.arcs[s] for s in states]
        return [(c, (t, *[o[c] for o in others])) for c, t in first.items() if all(c in o for o in others)]

    def shared(self, a: int, b: int) -> list[str]:
        """The texts accepted from both states: the composition behind the edit."""
        return ["".join(path) for (s, t), path in self.walk(a, b) if self.final[s] and self.final[t]]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests accepted from the state that differ by one edit of their first letter."""
        arcs, found = sorted(self.arcs[state].items()), []
        for k, (c, t) in enumerate(arcs):
            for d, u in arcs[k + 1 :]:
                found += [(c + rest, d + rest) for rest in self.shared(t, u)]
            found += [(c + rest, rest) for rest in self.shared(t, state) if not rest.startswith(c)]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words that one edit parts, once."""
        known: dict[int, list[tuple[str, str]]] = {}
        for (state,), path in self.walk(self.start):
            if state not in known:
                known[state] = self.edits(state)
            if known[state]:
                prefix = "".join(path)
                for a, b in known[state]:
                    yield prefix + a, prefix + b


def _edits_at(words: DataFrame, k: int) -> DataFrame:
    """Pairs of words that share their first k letters and differ by one edit of the next. One word per letter has a key, or is it."""
    letter, rest = F.substring("word", k + 1, 1), F.concat(F.substring("word", 1, k), F.expr(f"substring(word, {k + 2})"))
    cut = words.where(F.char_length("word") > k).select(rest.alias("key"), letter.alias("letter"), "word", "n")
    whole = words.select(F.col("word").alias("key"), F.lit("").alias("letter"), "word", "n")
    members = cut.union(whole).groupBy("key").agg(F.collect_list(F.struct("letter", "word", "n")).alias("members")).where(F.size("members") > 1)
    pairs = members.select("key", F.explode("members").alias("a"), "members").select("key", "a", F.explode("members").alias("b"))
    last = (F.col("a.letter") != "") | (F.substring("key", k + 1, 1) != F.col("b.letter"))
    return pairs.where((F.col("a.letter") < F.col("b.letter")) & last).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def _pairs_behind(words: DataFrame) -> DataFrame:
    """Pairs within each ``part``, by its acceptor."""

    def enumerated(table: pa.Table) -> pa.Table:
        counts = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        found = list(Acceptor(sorted(counts)).pairs())
        a, b = [p[0] for p in found], [p[1] for p in found]
        columns = [pa.array(a, pa.string()), pa.array([counts[w] for w in a], pa.int64()), pa.array(b, pa.string()), pa.array([counts[w] for w in b], pa.int64())]
        return pa.table(columns, names=["word", "n", "near", "near_n"])

    return words.groupBy("part").applyInArrow(enumerated, "word string, n long, near string, near_n long")


def near_pairs(words: DataFrame, scratch: Scratch, partition: int = PARTITION) -> DataFrame:
    """(word, n, near, near_n): every pair of different words (word, n) that one edit parts, in one direction.

    Words with a long common prefix that more than ``partition`` share cost a round per letter of it. The prefixes that are too
    full are broadcast: at most one per ``partition`` words.
    """
    pairs, parted, k = [], [], 0
    rest = words
    while True:
        prefix = F.substring("word", 1, k)
        sizes = rest.groupBy(prefix.alias("part")).agg(F.count(F.lit(1)).alias("words"))
        full = scratch.keep(sizes.where(F.col("words") > partition).select("part"), f"full{k}")
        keyed = rest.withColumn("part", prefix)
        parted.append(keyed.join(F.broadcast(full), "part", "left_anti"))
        if not full.head(1):
            break
        rest = scratch.keep(keyed.join(F.broadcast(full), "part", "left_semi").select("word", "n"), f"rest{k}")
        pairs.append(_edits_at(rest, k))
        k += 1
    # A letter before the prefix keeps a part apart from the same text as part of another length.
    parts = reduce(DataFrame.union, [p.select(F.concat(F.lit(f"{i}:"), "part").alias("part"), "word", "n") for i, p in enumerate(parted)])
    return reduce(DataFrame.union, [*pairs, _pairs_behind(parts)])


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every (word, form): the last of the forms of forms. Each round doubles the steps."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.keep(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        if not moved.where("moved").head(1):
            return moved.drop("moved")
        now = moved.drop("moved")


def group_variants(words: DataFrame, scratch: Scratch, lead: int = 5, partition: int = PARTITION) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word (word, n), each of which comes once.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of largest n,
    the first in code-point order among those that tie, if its n is at least ``lead`` times (2 or more) the word's; else it is null. ``root`` follows forms to the last one and
    is the word itself without a form. An empty vocabulary gives an empty result.
    """
    if lead < 2:
        raise ValueError("lead must be 2 at least, or forms could go in circles")
    words = scratch.keep(words.select("word", "n"), "words")
    pairs = scratch.keep(near_pairs(words, scratch, partition), "pairs")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    top_n = -F.col("best.less")
    leads: Column = top_n >= lead * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, top_n).alias("form_n")
    )
    judged = scratch.keep(judged, "judged")
    roots = _roots(judged.where("form is not null"), scratch)
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, lead: int = 5, slip: int = 199, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Near words, form and root of every word of the whole texts (see ``group_variants``).

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with at least ``min_chars`` code points and ``min_count`` occurrences.
    ``slip`` (0: none) leaves a letter out of some runs, by the crc32 of ``<id>:<run>``; a null id counts as no digits. Null and empty texts
    have no words. Repeated rows count each. Without words the result is empty. Other columns are ignored, whatever they are called.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    return group_variants(vocabulary(docs, min_chars, min_count, slip, id_col, text_col), scratch, lead)
