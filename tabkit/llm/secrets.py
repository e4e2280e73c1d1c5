"""Secret scans: fixed patterns, and a character convolutional network for what looks like their findings.

A candidate is a run of characters that secrets are made of. The network reads each with the text around it: characters become short vectors,
filters slide over them, and what each filter answers most, inside the candidate and around it, decides. It is
trained on all labelled candidates; by default those are the findings of the patterns against all other candidates. Half of the time the text before
is exchanged for that of another candidate, so that the network learns how a secret itself looks.

Scores are calibrated (a logistic fit on labelled candidates kept out of training, all with the text before of candidates that aren't secrets). Candidates fall into strata by the
characters they hold; in each, the cutoff is the highest that keeps the recall on the held-out secrets of the stratum at ``RECALL``
or more, by an exact binomial bound. A stratum with too few labelled secrets gets no cutoff, and the network adds nothing there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import running_before, salted
from .staging import Scratch

#: Patterns with the least length of what counts, and of which group. Texts are searched with A-Z lowered for the first.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS, LEAST_ASSIGNED = ("password", "passwd", "secret", "token", "api"), 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the network may find: at least so many characters of these.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MODEL = "model"

#: Characters of context before and after a candidate.
BEFORE, AFTER = 32, 8
#: All labelled candidates train or calibrate the network, copies once. A task trains on about so many (more, where there are more than
#: ``MOST_PARTS`` times as many), and what the tasks learned in an epoch is averaged.
PART, MOST_PARTS = 12_000, 64
#: Steps between the least and the largest logit among which a cutoff is first looked for, and candidates that one task numbers.
STEPS, NUMBERED = 4096, 200_000
#: Recall that a cutoff keeps, with this confidence, and the least secrets of a stratum that show it.
RECALL, CONFIDENCE = 0.95, 0.95
#: Sizes of the network and its training.
VECTOR, WIDTH, FILTERS, EPOCHS, BATCH, RATE, SEED = 8, 5, 24, 6, 64, 0.004, 11
#: Characters that one pass of the filters covers; a longer window is read in pieces.
PIECE = 4096
#: Letters are told apart by case; characters beyond ASCII count as one.
SYMBOLS = 130
PAD, OTHER = 128, 129


def base_findings(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that are long enough, in code points, by start, then kind as listed."""
    text, lowered, found = data.decode(errors="replace"), data.lower().decode(errors="replace"), []  # bytes lower A to Z alone
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(lowered) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def stratum(candidate: str) -> str:
    """Whether a candidate holds small letters, capital letters, digits."""
    return "".join(mark for mark, test in (("a", r"[a-z]"), ("A", r"[A-Z]"), ("0", r"[0-9]")) if re.search(test, candidate))


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[dict]:
    """Every candidate with its window and whether a finding overlaps it."""
    starts, ends = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        lead, before = min(BEFORE, start), bisect_left(starts, end)
        overlaps = before > 0 and ends[before - 1] > start
        yield {"start": start, "end": end, "lead": lead, "window": text[start - lead : end + AFTER], "label": overlaps}


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lead", pa.int32()), ("window", pa.string()), ("label", pa.bool_())]))
SPANS_SQL = "array<struct<kind: string, start: long, end: long>>"
FOUND_SQL = "array<struct<start: long, end: long, lead: int, window: string, label: boolean>>"


def _spans(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows], SPANS)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the last column, the text: base findings and candidates."""
    for batch in batches:
        *others, texts = batch.columns
        bases, founds = [], []
        for text in texts.cast(pa.binary()):
            data = text.as_py() or b""
            bases.append(base_findings(data))
            founds.append(list(candidates(data.decode(errors="replace"), bases[-1])))
        yield pa.record_batch([*others, _spans(bases), pa.array(founds, FOUND)], names=[*batch.schema.names[:-1], "base", "found"])


def _codes(window: str) -> np.ndarray:
    codes = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes, OTHER)


@dataclass
class Network:
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    shift: float
    #: Calibration: slope and offset of the logit.
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        vectors = rng.normal(0, 0.5, (SYMBOLS, VECTOR))
        vectors[PAD] = 0
        filters = rng.normal(0, 1 / math.sqrt(WIDTH * VECTOR), (WIDTH * VECTOR, FILTERS))
        return cls(vectors, filters, np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)

    def answers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters under each position's filter, as vectors, and what the filters answer. ``codes`` has a margin on both sides."""
        seen = np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=-1)
        under = self.vectors[seen].reshape(*seen.shape[:-1], WIDTH * VECTOR)
        return under, under @ self.filters + self.bias

    def _strongest(self, windows: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """What each filter answers most inside and around the candidates, at least 0, for windows of similar length."""
        long = max(map(len, windows))
        best = np.zeros((len(windows), 2, FILTERS))
        codes = np.full((len(windows), long + WIDTH - 1), PAD)
        for row, window in enumerate(windows):
            codes[row, WIDTH // 2 : WIDTH // 2 + len(window)] = _codes(window)
        start, end = np.array(spans).T[:, :, None]
        size = np.array([len(w) for w in windows])[:, None]
        for at in range(0, long, PIECE):
            _, answer = self.answers(codes[:, at : at + PIECE + WIDTH - 1])
            place = np.arange(at, at + answer.shape[1])
            inside = (place >= start) & (place < end)
            for side, mask in enumerate((inside, ~inside & (place < size))):
                best[:, side] = np.maximum(best[:, side], np.where(mask[:, :, None], answer, 0.0).max(axis=1))
        return best.reshape(len(windows), -1)

    def peaks(self, windows: list[str], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What each filter answers most inside and around the candidates, at least 0, and the characters it answers to."""
        own, long = np.arange(len(windows)), max(map(len, windows))
        best, places = np.full((len(windows), 2, FILTERS), -np.inf), np.zeros((len(windows), 2, FILTERS), int)
        codes = np.full((len(windows), long + WIDTH - 1), PAD)
        for row, window in enumerate(windows):
            codes[row, WIDTH // 2 : WIDTH // 2 + len(window)] = _codes(window)
        start, end = np.array(spans).T[:, :, None]
        size = np.array([len(w) for w in windows])[:, None]
        for at in range(0, long, PIECE):
            _, answer = self.answers(codes[:, at : at + PIECE + WIDTH - 1])
            place = np.arange(at, at + answer.shape[1])
            inside = (place >= start) & (place < end)
            for side, mask in enumerate((inside, ~inside & (place < size))):
                masked = np.where(mask[:, :, None], answer, -np.inf)
                pick = masked.argmax(axis=1)
                top = np.take_along_axis(masked, pick[:, None, :], axis=1)[:, 0]
                better = top > best[:, side]
                best[:, side] = np.where(better, top, best[:, side])
                places[:, side] = np.where(better, at + pick, places[:, side])
        return np.maximum(best, 0.0), codes[own[:, None, None, None], places[..., None] + np.arange(WIDTH)]

    def logits(self, windows: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """The network's answer for each window, whose candidate lies at the span. Windows of any length."""
        out, at = np.empty(len(windows)), 0
        order = sorted(range(len(windows)), key=lambda row: len(windows[row]))
        while at < len(order):
            rows = order[at : at + BATCH]
            while len(rows) > 1 and len(windows[rows[-1]]) > max(PIECE, 2 * len(windows[rows[0]])):
                rows = rows[: len(rows) // 2]
            out[rows] = self._strongest([windows[r] for r in rows], [spans[r] for r in rows]) @ self.weights + self.shift
            at += len(rows)
        return out

    def scores(self, windows: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows, spans) + self.offset, -500, 500)))


def _behind(window: str, span: tuple[int, int], before: str) -> tuple[str, tuple[int, int]]:
    """The candidate behind another text."""
    start, end = span
    return before + window[start:], (len(before), len(before) + end - start)


NAMES = ["vectors", "filters", "bias", "weights", "shift"]


@dataclass
class Training:
    """A network on its way, with the moments of Adam."""

    net: Network
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @classmethod
    def fresh(cls) -> Training:
        net = Network.fresh()
        zeros = [{n: np.zeros_like(np.asarray(getattr(net, n), float)) for n in NAMES} for _ in range(2)]
        return cls(net, *zeros)

    def packed(self) -> np.ndarray:
        return np.concatenate([np.ravel(part[n]).astype(float) for part in (vars(self.net), self.first, self.second) for n in NAMES] + [[float(self.step)]])

    @classmethod
    def unpacked(cls, numbers: np.ndarray) -> Training:
        out, at = cls.fresh(), 0
        for part in (vars(out.net), out.first, out.second):
            for n in NAMES:
                shape = np.shape(part[n])
                size = math.prod(shape)
                part[n] = numbers[at : at + size].reshape(shape) if shape else float(numbers[at])
                at += size
        out.step = round(numbers[at])
        return out

    def epochs(self, windows: list[str], spans: list[tuple[int, int]], labels: np.ndarray, share: tuple[float, float], epochs: int, rng: np.random.Generator) -> None:
        """Adam on the logistic loss. ``share`` weighs secrets and others."""
        net, weight = self.net, np.where(labels, *share)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                others = [int(rng.integers(len(windows))) if rng.random() < 0.5 else r for r in rows]
                seen_as = [_behind(windows[r], spans[r], windows[o][: spans[o][0]]) for r, o in zip(rows, others, strict=True)]
                # Long windows are read alone, so that a batch does not become as long as its longest.
                tops, seen = np.empty((len(rows), 2, FILTERS)), np.empty((len(rows), 2, FILTERS, WIDTH), int)
                short = [k for k, (w, _) in enumerate(seen_as) if len(w) <= PIECE]
                for group in [short, *[[k] for k, (w, _) in enumerate(seen_as) if len(w) > PIECE]]:
                    if group:
                        tops[group], seen[group] = net.peaks([seen_as[k][0] for k in group], [seen_as[k][1] for k in group])
                hidden = tops.reshape(len(rows), -1)
                z = np.clip(hidden @ net.weights + net.shift, -500, 500)
                error = (1 / (1 + np.exp(-z)) - labels[rows]) * weight[rows] / len(rows)
                grads = {"weights": error @ hidden, "shift": error.sum(), "filters": np.zeros_like(net.filters), "bias": np.zeros(FILTERS), "vectors": np.zeros_like(net.vectors)}
                back = error[:, None] * net.weights * (hidden > 0)
                under = net.vectors[seen].reshape(len(rows), 2, FILTERS, WIDTH * VECTOR)
                for side in range(2):
                    part = back[:, side * FILTERS : (side + 1) * FILTERS]
                    grads["bias"] += part.sum(axis=0)
                    grads["filters"] += np.einsum("rfd,rf->df", under[:, side], part)
                    to = part[:, :, None] * net.filters.T[None]
                    np.add.at(grads["vectors"], seen[:, side], to.reshape(*seen[:, side].shape, VECTOR))
                grads["vectors"][PAD] = 0
                self.step += 1
                for n in NAMES:
                    self.first[n] = 0.9 * self.first[n] + 0.1 * grads[n]
                    self.second[n] = 0.999 * self.second[n] + 0.001 * np.square(grads[n])
                    move = RATE * (self.first[n] / (1 - 0.9**self.step)) / (np.sqrt(self.second[n] / (1 - 0.999**self.step)) + 1e-8)
                    setattr(net, n, getattr(net, n) - move)


def _shares(secrets: int, others: int) -> tuple[float, float]:
    """Weights of a secret and of another candidate: both classes count alike, and 1 on average."""
    return 0.5 / max(1, secrets) * (secrets + others), 0.5 / max(1, others) * (secrets + others)


def _trained(windows: list[str], spans: list[tuple[int, int]], labels: np.ndarray) -> Network:
    training = Training.fresh()
    training.epochs(windows, spans, labels, _shares(int(labels.sum()), int((~labels).sum())), EPOCHS, np.random.default_rng(SEED))
    return training.net


def _calibrated(net: Network, windows: list[str], spans: list[tuple[int, int]], labels: np.ndarray) -> Network:
    """Slope and offset of the logit by Newton steps on the held-out logistic loss, with a small ridge."""
    x, y = net.logits(windows, spans), labels.astype(float)
    scale = max(1.0, float(np.abs(x).max(initial=0.0)))
    design, theta = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        theta -= np.linalg.solve(hess, design.T @ (p - y) + 0.01 * theta)
    return replace(net, slope=max(theta[0], 1e-6) / scale, offset=float(theta[1]))


def _lost_at_most(n: int) -> int:
    """How many of n held-out secrets may fall below a cutoff so that its recall is ``RECALL`` with ``CONFIDENCE``; -1 if n is too small."""
    below, lost = 0.0, -1
    while lost < n:
        below += math.comb(n, lost + 1) * (1 - RECALL) ** (lost + 1) * RECALL ** (n - lost - 1)
        if below > 1 - CONFIDENCE:
            break
        lost += 1
    return lost


def cutoffs(scores: np.ndarray, labels: np.ndarray, strata: list[str]) -> dict[str, float]:
    """Per stratum, the highest score that loses no more held-out secrets than the bound allows."""
    out, strata = {}, np.array(strata, dtype=object)
    for name in sorted(set(strata[labels])):
        own = np.sort(scores[labels & (strata == name)])
        lost = _lost_at_most(min(len(own), 500))
        if lost >= 0:
            out[name] = float(own[lost * len(own) // min(len(own), 500)])
    return out


def train(labelled: list[tuple[str, int, int, bool, bool]]) -> tuple[Network, dict[str, float]] | None:
    """Network and cutoffs from (window, start, end, is a secret, is held out); none without secrets and others on both sides."""
    sides = []
    for held in (False, True):
        rows = [r for r in labelled if r[4] == held]
        labels = np.array([r[3] for r in rows], bool)
        if not labels.any() or labels.all():
            return None
        sides.append(([r[0] for r in rows], [(r[1], r[2]) for r in rows], labels))
    (windows, spans, labels), (held_out, places, held_labels) = sides
    # The text before comes from candidates that aren't secrets, so that the recall does not rest on a telling word.
    plain = [w[:s] for w, (s, _), secret in zip(held_out, places, held_labels, strict=True) if not secret]
    moved = [_behind(w, p, plain[k % len(plain)]) for k, (w, p) in enumerate(zip(held_out, places, strict=True))]
    held_out, places = [w for w, _ in moved], [p for _, p in moved]
    net = _calibrated(_trained(windows, spans, labels), held_out, places, held_labels)
    return net, cutoffs(net.scores(held_out, places), held_labels, [stratum(w[s:e]) for w, (s, e) in moved])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """All columns but the text, ``base`` and ``spans``: arrays of (kind, start, end) by start, then kind; in code points, the end exclusive.

    ``base`` holds what the patterns find, ``spans`` also what the network adds, as kind ``model``: candidates that no finding of the patterns overlaps.
    ``labelled`` may give labelled candidates of another origin: (window, start, end, label), the candidate's place in its window.
    All of them, copies once, train or calibrate the network, in tasks; every candidate of every text is judged.

    Null and empty texts have no spans. Texts of any length are read whole, and once. Repeated rows are judged alike. A table without findings or without other
    candidates, or an empty one, gets no model. Spans that tie in start and kind don't occur. Columns may have any names;
    ``base`` and ``spans`` among them are replaced.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    others = [c for c in docs.columns if c not in (text_col, "base", "spans")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).cast("string").alias("text"))
    kept = own.drop("text").schema
    scanned = scratch.keep(own.mapInArrow(_scanned, _with(kept, base=SPANS_SQL, found=FOUND_SQL)), "scanned")
    if labelled is None:
        each = scanned.select(F.explode("found").alias("f"))
        labelled = each.select("f.window", F.col("f.lead").alias("start"), F.expr("f.lead + f.end - f.start").alias("end"), "f.label")
    model = train_on(labelled, scratch)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, bases, founds = batch.columns
            spans = [[tuple(b.values()) for b in base] for base in bases.to_pylist()]
            if model:
                net, least = model
                rows = [(k, f) for k, found in enumerate(founds.to_pylist()) for f in found if not f["label"]]
                scores = net.scores([f["window"] for _, f in rows], [(f["lead"], f["lead"] + f["end"] - f["start"]) for _, f in rows])
                for (k, f), score in zip(rows, scores, strict=True):
                    body = f["window"][f["lead"] : f["lead"] + f["end"] - f["start"]]
                    if score >= least.get(stratum(body), math.inf):
                        spans[k].append((MODEL, f["start"], f["end"]))
            ranked = [sorted(s, key=lambda x: (x[1], [*KINDS, MODEL].index(x[0]))) for s in spans]
            yield pa.record_batch([*rest, bases, _spans(ranked)], names=[*batch.schema.names[:-1], "spans"])

    out = scanned.mapInArrow(judged, _with(kept, base=SPANS_SQL, spans=SPANS_SQL))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "base", "spans")


def _with(schema: T.StructType, **more: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more.items()]])


def _learned(rows: DataFrame, secrets: int, others: int) -> Network:
    """Trained on all rows (window, start, end, label, rank): parts by hash are trained side by side, and averaged after every epoch."""
    parts = min(MOST_PARTS, -(-(secrets + others) // PART))
    share, training = _shares(secrets, others), Training.fresh().packed()
    dealt = rows.withColumn("part", F.pmod("rank", F.lit(parts)))

    def turn_of(turn: int, epochs: int, now: np.ndarray):
        def learn(table: pa.Table) -> pa.Table:
            own = sorted(table.to_pylist(), key=lambda r: (not r["label"], r["rank"], r["window"], r["start"], r["end"]))
            rng = np.random.default_rng(SEED if parts == 1 else [SEED, turn, own[0]["part"]])
            state = Training.unpacked(now)
            state.epochs([r["window"] for r in own], [(r["start"], r["end"]) for r in own], np.array([r["label"] for r in own], bool), share, epochs, rng)
            return pa.table({"part": pa.array([own[0]["part"]], pa.int64()), "n": pa.array([len(own)], pa.int64()), "state": pa.array([state.packed().tobytes()], pa.binary())})

        return learn

    for turn in range(1 if parts == 1 else EPOCHS):
        learn = turn_of(turn, EPOCHS if parts == 1 else 1, training)
        # One network of fixed size per part comes to the driver.
        states = sorted(dealt.groupBy("part").applyInArrow(learn, "part long, n long, state binary").collect(), key=lambda r: r["part"])
        training = sum(np.frombuffer(r["state"]) * r["n"] for r in states) / sum(r["n"] for r in states) if parts > 1 else np.frombuffer(states[0]["state"])
    return Training.unpacked(training).net


def _calibrated_on(net: Network, held: DataFrame) -> Network:
    """As ``_calibrated``, over rows (logit, label): five sums come to the driver for every step."""
    largest = held.agg(F.max(F.abs("logit"))).first()[0]
    scale, theta = max(1.0, largest), np.zeros(2)
    for _ in range(25):
        x, y = F.col("logit") / scale, F.col("label").cast("double")
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * float(theta[0]) + float(theta[1])))
        rows = held.select(x.alias("x"), y.alias("y"), (1 / (1 + F.exp(-z))).alias("p")).selectExpr("x", "p * (1 - p) as w", "p - y as e")
        r = rows.selectExpr("sum(x * x * w) as xx", "sum(x * w) as x", "sum(w) as w", "sum(x * e) as xe", "sum(e) as e").first()
        hess = np.array([[r["xx"], r["x"]], [r["x"], r["w"]]]) + 0.01 * np.eye(2)
        move = np.linalg.solve(hess, np.array([r["xe"], r["e"]]) + 0.01 * theta)
        theta -= move
        if np.abs(move).max() <= 1e-9 * max(1.0, np.abs(theta).max()):
            break
    return replace(net, slope=max(theta[0], 1e-6) / scale, offset=float(theta[1]))


def _cutoffs_on(net: Network, held: DataFrame) -> dict[str, float]:
    """As ``cutoffs``, over rows (logit, label, stratum): exact ranks, by counts per step of the logit and then the values of one step."""
    own = held.where("label").withColumn("step", F.floor(F.col("logit") * (STEPS / max(1.0, held.agg(F.max(F.abs("logit"))).first()[0]))))
    steps: dict[str, list] = {}
    for r in own.groupBy("stratum", "step").count().orderBy("stratum", "step").collect():
        steps.setdefault(r["stratum"], []).append((r["step"], r["count"]))
    wanted = {}
    for name, counts in steps.items():
        n = sum(c for _, c in counts)
        lost, before = _lost_at_most(min(n, 500)), 0
        if lost < 0:
            continue
        rank = lost * n // min(n, 500)
        for step, count in counts:
            if before <= rank < before + count:
                wanted[name] = (step, rank - before)
            before += count
    if not wanted:
        return {}
    within = F.lit(False)
    for name, (step, _) in wanted.items():
        within = within | ((F.col("stratum") == name) & (F.col("step") == step))
    out = {}
    for r in own.where(within).groupBy("stratum", "logit").count().orderBy("stratum", "logit").collect():
        step, rank = wanted[r["stratum"]]
        if 0 <= rank < r["count"]:
            out[r["stratum"]] = float(1 / (1 + np.exp(-np.clip(net.slope * r["logit"] + net.offset, -500, 500))))
        wanted[r["stratum"]] = (step, rank - r["count"])
    return out


def train_on(labelled: DataFrame, scratch: Scratch) -> tuple[Network, dict[str, float]] | None:
    """As ``train``, over all rows (window, start, end, label) of a table, copies once; a third, by the hash of the candidate itself, is held out."""
    each = labelled.where("label is not null").selectExpr("window", "cast(start as int) as start", "cast(`end` as int) as `end`", "label").distinct()
    held = F.pmod(F.xxhash64(F.expr("substring(window, start + 1, `end` - start)")), F.lit(3)) == 0
    each = scratch.keep(each.withColumns({"held": held, "rank": F.xxhash64("window", "start", "end")}), "labelled")
    counts = {(r["held"], r["label"]): r["count"] for r in each.groupBy("held", "label").count().collect()}
    if len(counts) < 4:
        return None
    net = _learned(each.where("not held").drop("held"), counts[False, True], counts[False, False])
    # The text before comes from candidates that aren't secrets, so that the recall does not rest on a telling word.
    secrets, others = counts[True, True], counts[True, False]
    order = [F.col(c) for c in ("rank", "window", "start", "end")]
    numbered = running_before(each.where("held"), ["label"], F.col("rank"), salted(NUMBERED, secrets + others), order, F.lit(1), "number")
    plain = numbered.where("not label").select(F.col("number").alias("turn"), F.expr("substring(window, 1, start)").alias("before"))
    turn = F.pmod(F.col("number") + F.when(F.col("label"), 0).otherwise(secrets), F.lit(others))
    moved = numbered.withColumn("turn", turn).join(plain, "turn").select("window", "start", "end", "before", "label")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                seen_as = [_behind(r["window"], (r["start"], r["end"]), r["before"]) for r in rows]
                logits = net.logits([w for w, _ in seen_as], [p for _, p in seen_as])
                strata = [stratum(w[s:e]) for w, (s, e) in seen_as]
                yield pa.record_batch([pa.array(logits), batch.column("label"), pa.array(strata)], names=["logit", "label", "stratum"])

    judged = scratch.keep(moved.mapInArrow(scored, "logit double, label boolean, stratum string"), "held")
    net = _calibrated_on(net, judged)
    return net, _cutoffs_on(net, judged)
