"""Importance resampling: documents drawn in proportion to how much likelier they are under target text.

Words and punctuation, lower-cased, and their pairs are hashed into buckets, each kind into a half of them. Two generative
models are counts of buckets: over all documents (raw) and over labelled good ones (target). A document's log weight is the
sum, over its n-grams, of the log ratio of the two. The log ratio of smoothed counts is multiplied by the probability, given
the counts, that the bucket's share of the target isn't that of all buckets: rare n-grams count a little each, and estimation noise
doesn't add up in long texts. The prior of that probability and k are set by labelled documents, each good one weighed as if it
weren't in the target. Documents are drawn without replacement by Gumbel top-k: the k largest sums of log weight and Gumbel
noise, the noise being a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch
from .text import BASE, LOWER, Texts, mix, pieces, range_hashes

#: Buckets of a model, which every task gets.
BUCKET_BITS = 20
#: By default, at most so many labelled good documents make the target model: those whose ids have the smallest hashes. As many others are held against them.
TARGET_DOCS = 50_000
#: Of labelled good documents, at most this share may weigh less than the cut that sets k.
GOOD_LOST = 0.01
#: Shares of the buckets that tell target from raw, before their counts are seen. The first is taken unless another does better.
PRIORS = (1e-3, 1e-2, 1e-4, 1e-5, 1e-6)
#: The prior without labelled others; the cut is then so far below the good documents, as the noise of the draw is about that.
CAUTIOUS = 1e-6
MARGIN = 3.0

#: 0 blank, 1 letter, digit or a byte beyond ASCII, 2 anything else.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def token_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams, and for each the row of the text it is from."""
    data = LOWER[texts.data]
    kind = KIND[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    real = kind[start] != 0
    start, end = start[real], end[real]
    row = np.searchsorted(texts.offsets, start, side="right") - 1
    hashes = range_hashes(data, start, end)
    same = row[1:] == row[:-1]
    pairs = mix(hashes[:-1] * np.uint64(BASE) + hashes[1:])[same]
    grams = np.concatenate([hashes, pairs]) >> np.uint64(65 - BUCKET_BITS)
    grams[len(hashes) :] += np.uint64(1 << (BUCKET_BITS - 1))
    return grams.astype(np.int64), np.concatenate([row, row[1:][same]])


def model_counts(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of raw and target text. A row per bucket comes to the driver.

    ``target`` has at most ``target_docs`` ids and is broadcast, so that no text is shuffled.
    """
    marked = target.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target"))
    marked = docs.join(F.broadcast(marked), F.col("doc_id") == F.col("__id"), "left").select("text", F.col("__target").isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = (np.zeros(1 << BUCKET_BITS, np.int64) for _ in range(2))
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for texts in pieces(batch.column(0)):
                grams, row = token_buckets(texts)
                raw += np.bincount(grams, minlength=len(raw))
                good += np.bincount(grams[is_target[texts.first_row + row].astype(bool)], minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], names=["bucket", "raw", "good"])

    sums = marked.mapInArrow(counted, "bucket long, raw long, good long").groupBy("bucket")
    got = sums.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = (np.zeros(1 << BUCKET_BITS) for _ in range(2))
    raw[got["bucket"].to_numpy()] = got["raw"].to_numpy()
    good[got["bucket"].to_numpy()] = got["good"].to_numpy()
    return raw, good


def shrunk_ratios(raw: np.ndarray, good: np.ndarray, share: float, prior: float) -> np.ndarray:
    """log(target / raw) of buckets, times the probability that it isn't 0; ``share`` of all n-grams are the target's.

    A bucket tells nothing (``good`` is binomial with ``share``) or, with probability ``prior``, has a share of its own, any alike.
    """
    share = min(max(share, 1e-12), 1 - 1e-6)
    part = good / np.maximum(raw, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(good > 0, good * np.log(part / share), 0.0) + np.where(raw > good, (raw - good) * np.log((1 - part) / (1 - share)), 0.0)
    odds = apart - 0.5 * np.log(raw + 1) + np.log(prior / (1 - prior))
    return np.log((good + 1) / (raw * share + 1)) / (1 + np.exp(-np.clip(odds, -50, 50)))


def log_ratios(raw: np.ndarray, good: np.ndarray, prior: float = CAUTIOUS) -> np.ndarray:
    """log(target / raw) of each bucket, shrunk; 0 without a target."""
    if not good.sum():
        return np.zeros(len(raw), np.float32)
    return shrunk_ratios(raw, good, good.sum() / raw.sum(), prior).astype(np.float32)


def held_out_weights(docs: DataFrame, target: DataFrame, others: DataFrame, raw: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every document of ``target`` and ``others`` whether it is the target's, and its log weight by each of ``PRIORS``.

    A document of the target is weighed by the model without its own n-grams. Two tables of at most ``target_docs`` ids are
    broadcast; a row per id comes to the driver, with the least weights of an id's rows.
    """
    marked = target.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target"))
    marked = marked.union(others.select("doc_id", F.lit(False)))
    marked = docs.join(F.broadcast(marked), F.col("doc_id") == F.col("__id")).select("text", "__target", "__id")
    models = docs.sparkSession.sparkContext.broadcast((raw, good, good.sum() / raw.sum()))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, share = models.value
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            out = np.zeros((len(PRIORS), batch.num_rows))
            for texts in pieces(batch.column(0)):
                grams, row = token_buckets(texts)
                n = len(texts.offsets) - 1
                found, own = np.unique(row.astype(np.int64) << BUCKET_BITS | grams, return_counts=True)
                row, grams = found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)
                rest = good[grams] - own * is_target[texts.first_row + row]
                for k, prior in enumerate(PRIORS):
                    out[k, texts.first_row : texts.first_row + n] = np.bincount(row, own * shrunk_ratios(raw[grams], rest, share, prior), n)
            columns = [batch.column(2).cast(pa.int64()), pa.array(is_target), *[pa.array(weights) for weights in out]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "target", *names])

    names = [f"w{k}" for k in range(len(PRIORS))]
    rows = marked.mapInArrow(weighed, ", ".join(["id long", "target boolean", *[f"{name} double" for name in names]]))
    got = rows.groupBy("id", "target").agg(*[F.min(name).alias(name) for name in names]).toArrow()
    models.unpersist()
    weights = np.array([got[name].to_numpy() for name in names])
    return got["target"].to_numpy().astype(bool), weights


def best_cut(is_good: np.ndarray, weights: np.ndarray) -> tuple[float, float] | None:
    """The prior and cut that, of those that lose at most ``GOOD_LOST`` of the good documents, have the largest share of the others
    below less the share of the good ones below; None without good documents. Of equals, the first prior and the lowest cut."""
    n = int(is_good.sum())
    if not n:
        return None
    if is_good.all():
        return CAUTIOUS, float(weights[PRIORS.index(CAUTIOUS)].min()) - MARGIN
    best, most = None, -np.inf
    for prior, own in zip(PRIORS, weights, strict=True):
        cuts = np.sort(own[is_good])[: int(n * GOOD_LOST) + 1]
        lost = np.searchsorted(cuts, cuts)
        others = np.sort(own[~is_good])
        gain = np.searchsorted(others, cuts) / max(len(others), 1) - lost / n
        at = int(np.argmax(gain))
        if gain[at] > most:
            best, most = (prior, float(cuts[at])), gain[at]
    return best


def log_weights(docs: DataFrame, keep: list[str], ratios, text: str) -> DataFrame:
    """The columns ``keep`` of every row, and ``log_weight``."""
    at, few = ([*keep, text]).index(text), len(keep)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for texts in pieces(batch.column(at)):
                grams, row = token_buckets(texts)
                n = len(texts.offsets) - 1
                out[texts.first_row : texts.first_row + n] = np.bincount(row, ratios.value[grams], n)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(few)], pa.array(out)], names=[*keep, "log_weight"])

    rows = docs.select(*keep, *([text] if at == few else []))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:few]]
    return rows.mapInArrow(weighed, ", ".join([*fields, "log_weight double"]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, always the same for an id and a seed; rows without an id share one value."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting ever finer ranges; None if there are fewer. No sort, no single task.

    Each round counts 2**12 equal ranges of the interval that holds the value, until it holds one value.
    """
    total, low, high = keys.agg(F.count(column), F.min(column), F.max(column)).first()
    if k < 1 or total < k:
        return None
    rank, parts = k, 1 << 12
    while low < high:
        width = (high - low) / parts
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1)).cast("int")
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(part.alias("part"))
        bins = inside.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for cell in sorted(bins, key=lambda b: -b.part):
            if rank <= cell.n:
                low, high = cell.low, cell.high
                break
            rank -= cell.n
    return low


def _fit(docs: DataFrame, labels: DataFrame, target_docs: int):
    """The broadcast log ratios, and the cut between labelled good and other documents."""
    usable = labels.where(F.col("doc_id").isNotNull())
    marks = usable.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    is_good = (F.col("q") == 1) & (F.col("t") == 0)
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    target, others = (marks.where(side).select("doc_id").orderBy(*first).limit(target_docs) for side in (is_good, ~is_good))
    raw, good = model_counts(docs, target)
    best = best_cut(*held_out_weights(docs, target, others, raw, good)) if good.sum() else None
    prior, cut = best or (CAUTIOUS, None)
    return docs.sparkSession.sparkContext.broadcast(log_ratios(raw, good, prior)), cut


def _draw(weights: DataFrame, cut: float | None, seed: int, share: float | None) -> float | None:
    """The smallest key drawn. k is ``share`` of the documents or, if not given, as many as weigh at least ``cut``."""
    if share is not None:
        k = int(round(share * weights.count()))
    elif cut is None:
        return None
    else:
        k = weights.where(F.col("log_weight") >= cut).count()
    return kth_largest(weights.select((F.col("log_weight") + gumbel(F.col("doc_id"), seed)).alias("key")), "key", k)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 7, share: float | None = None, target_docs: int = TARGET_DOCS) -> DataFrame:
    """doc_id, ``log_weight``, ``gumbel_key`` and ``kept`` of every document.

    ``target_docs`` bounds the labelled good documents that make the target model, and the others held against them.
    Without labelled good documents every log ratio is 0; then, without ``share``, all are kept. Null and empty texts have
    log weight 0. Repeated rows are weighed alike and drawn alike; so a draw may hold a few rows more than k, where keys tie.
    A document with several labels is good if none says otherwise; null labels count as bad. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    own = docs.select("doc_id", "text")
    ratios, cut = _fit(own, labels, target_docs)
    weights = scratch.keep(log_weights(own, ["doc_id"], ratios, "text"), "weights")
    least = _draw(weights, cut, seed, share)
    key = F.col("log_weight") + gumbel(F.col("doc_id"), seed)
    return weights.select("doc_id", "log_weight", key.alias("gumbel_key"), (key >= least if least is not None else F.lit(True)).alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame, seed: int = 7, share: float | None = None, target_docs: int = TARGET_DOCS) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with their columns; texts are weighed anew instead of shuffled."""
    scratch = Scratch(docs.sparkSession, "importance")
    own = docs.select("doc_id", "text")
    ratios, cut = _fit(own, labels, target_docs)
    weights = scratch.keep(log_weights(own, ["doc_id"], ratios, "text"), "weights")
    least = _draw(weights, cut, seed, share)
    scratch.drop(weights)
    if least is None:
        return docs
    names = docs.columns
    clash = {c: f"__{c}" for c in names if c.lower() == "log_weight"}
    weighed = log_weights(docs.withColumnsRenamed(clash), [clash.get(c, c) for c in names], ratios, "text")
    kept = weighed.where(F.col("log_weight") + gumbel(F.col("doc_id"), seed) >= least)
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in names])
