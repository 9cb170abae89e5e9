"""Quality classifier by Bradley-Terry pairwise ranking.

Each labelled text of label 1 is preferred to each of label 0. The model learns a linear score from preference pairs by
logistic loss on the difference of their features; P(a before b) = sigmoid(s(a) - s(b)). A score quantile of the
training texts (the share of label 0 among them) is the threshold between the labels; scores are shifted to stand at
0.3 there and squashed to 0..1.

Every labelled training text is learned from, and every pair of a text of label 1 with one of label 0 counts. What a pair
adds to the loss depends on two scores only, so Newton's steps need sums of the features over texts of about one score
(steps of ``STEP``, at their mean score), which Spark adds up; no pair is ever made. The quantile is exact over all
training texts. Features are computed once a text and kept. Labels, lang, source and ids are never features.

Defined results: null and empty texts are scored by the features of an empty text; without pairs (no labels, or one
label only) every weight is zero and every score 0.5; null labels and ids without a text are not learned from;
repeated rows get equal scores; empty tables give empty tables; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, kept, table, window_hashes

#: Newton steps at most, the largest change of a weight in one and the change at which they end, weight decay.
STEPS, LONGEST, ENOUGH, DECAY = 20, 2.0, 1e-3, 1e-3
#: Width of a score step, and the score beyond which texts share the last one.
STEP, REACH = 1 / 32, 32.0
AT_THRESHOLD = 0.3
FEATURES = ("log_words", "chars_a_word", "symbols", "upper", "digits", "punctuation", "non_ascii", "repeated_windows", "repeated_neighbours", "dup_lines", "distinct")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


SYMBOLS, UPPER, DIGITS, PUNCTUATION = mask(b"#*$%&|<>@^~_=+\\{}[]"), mask(bytes(range(65, 91))), mask(bytes(range(48, 58))), mask(b"!?\"'();:")
NON_ASCII = mask(bytes(range(128, 256)))


def features_of(text: bytes | None, ids: WordIds) -> list[float]:
    """Features of a whole text, each within a bounded range whatever the text's length."""
    text = text or b""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, n)
    windows = window_hashes(h, 5)
    repeated = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0
    neighbours = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    # distinct words among the first and any further 200 words, so that long texts compare with short ones
    distinct = float(np.mean([len(np.unique(h[i : i + 200])) / len(h[i : i + 200]) for i in range(0, n, 200)])) if n else 0.0
    return [
        float(np.log1p(n)),
        min(20.0, (size - counts[[9, 10, 11, 12, 13, 32]].sum()) / max(1, n)),
        min(0.3, float(counts @ SYMBOLS) / max(1, n)),
        min(0.3, float(counts @ UPPER) / size),
        float(counts @ DIGITS) / size,
        float(counts @ PUNCTUATION) / size,
        float(counts @ NON_ASCII) / size,
        min(0.4, repeated),
        neighbours,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        distinct,
    ]


def feature_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    class Hashes(WordIds):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= self.LIMIT:
                self.clear()
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    ids = Hashes()
    for b in batches:
        yield b, np.array([features_of(t.as_py(), ids) for t in b.column(text)], np.float64).reshape(-1, len(FEATURES))


def dot(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``z @ weights``, added up in one order wherever a row stands in its batch."""
    out = np.zeros(len(z))
    for k, w in enumerate(weights):
        out += z[:, k] * w
    return out


@dataclass
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return dot(self.scaled(x), self.weights)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -40, 40)))


#: Score steps of a label; slots of label 1 follow those of label 0.
SLOTS = 2 * int(REACH / STEP) + 1
UPPER_ROWS, UPPER_COLS = np.triu_indices(len(FEATURES))
#: Columns of the sums of a slot: texts, features, products of features.
SUMS = 1 + len(FEATURES) + len(UPPER_ROWS)


def slot_sums(z: np.ndarray, label: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots (label and score step) that occur and their sums."""
    slot = np.rint((np.clip(dot(z, weights), -REACH, REACH) + REACH) / STEP).astype(np.int64) + SLOTS * label.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, z = slot[order], z[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    columns = np.hstack([np.ones((len(z), 1)), z, z[:, UPPER_ROWS] * z[:, UPPER_COLS]])
    return slot[first], np.add.reduceat(columns, first, axis=0) if len(first) else np.empty((0, SUMS))


def newton_step(slot: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A Newton step of the mean logistic loss over all (label 1, label 0) pairs with decay."""
    m = len(weights)
    (n0, x0, xx0), (n1, x1, xx1) = ((t[:, 0], t[:, 1 : 1 + m], t[:, 1 + m :]) for t in (sums[slot < SLOTS], sums[slot >= SLOTS]))
    apart = (x1 @ weights / n1)[:, None] - (x0 @ weights / n0)[None, :]
    lost = 1 / (1 + np.exp(np.clip(apart, -40, 40)))
    bend = lost * (1 - lost)
    pairs = n1.sum() * n0.sum()
    slope = ((lost @ n0) @ x1 - (n1 @ lost) @ x0) / pairs - DECAY * weights
    own = np.zeros((m, m))
    own[UPPER_ROWS, UPPER_COLS] = (bend @ n0) @ xx1 + (n1 @ bend) @ xx0
    own += np.triu(own, 1).T
    across = x1.T @ bend @ x0
    step = np.linalg.solve((own - across - across.T) / pairs + DECAY * np.eye(m), slope)
    return step * min(1.0, LONGEST / max(np.abs(step).max(), 1e-12))


def single(x: np.ndarray) -> np.ndarray:
    """Rounded to single precision, so that the order in which sums were added doesn't show."""
    return np.asarray(x, np.float32).astype(np.float64)


def learned(sums_at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights by Newton's method; ``sums_at`` gives the slots and sums of all training texts at given weights."""
    weights = np.zeros(len(FEATURES))
    for _ in range(STEPS):
        step = newton_step(*sums_at(weights), weights)
        weights = single(weights + step)
        if np.abs(step).max() < ENOUGH:
            break
    return weights


def unlearned() -> Ranker:
    zero = np.zeros(len(FEATURES))
    return Ranker(zero, zero, zero + 1, 0.0)


def cut_rank(n: int, bad: int) -> int:
    """The threshold lies between the scores of this rank (from 1) and the next."""
    return min(max(bad, 1), n - 1)


def fit(x: np.ndarray, label: np.ndarray, pairs: int | None = None) -> Ranker:
    """The model of rows in memory. All pairs count, whatever ``pairs`` says."""
    bad = int((label == 0).sum())
    if not bad or not (label == 1).any():
        return unlearned()
    r = Ranker(np.zeros(x.shape[1]), single(x.mean(axis=0)), single(np.maximum(x.std(axis=0), 1e-6)), 0.0)
    z = r.scaled(x)
    r.weights = learned(lambda w: slot_sums(z, label, w))
    s = np.sort(r.raw(x))
    k = cut_rank(len(s), bad)
    r.threshold = float((s[k - 1] + s[k]) / 2)
    return r


def arrays(column: pa.Array) -> np.ndarray:
    """Feature rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) per row of ``docs``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in feature_batches(batches, 2):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(features, f"doc_id {kind}, held_out boolean, x array<double>")


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers ``x``."""
    i = (x + 0.0).view(np.int64)  # one zero
    return i ^ ((i >> 63) & np.int64((1 << 63) - 1))


def number(i: int) -> float:
    k = np.array([i], np.int64)
    return float((k ^ ((k >> 63) & np.int64((1 << 63) - 1))).view(np.float64)[0])


def order_statistics(keys: DataFrame, rank: int) -> tuple[int, int]:
    """The keys (key, long) of ``rank`` (from 1) and of the next rank, found 16 bits at a time."""
    left, here, below = rank, keys, 0
    for shift in (48, 32, 16, 0):
        high = F.shiftright("key", shift)
        counts = sorted((r["high"], r["n"]) for r in here.groupBy(high.alias("high")).agg(F.count("*").alias("n")).collect())
        for prefix, n in counts:
            if left <= n:
                break
            left, below = left - n, below + n
        here = keys.where(high == prefix)
    # n rows hold the key of this rank
    return prefix, prefix if left < n else keys.where(F.col("key") > prefix).agg(F.min("key")).first()[0]


def fit_table(train: DataFrame) -> Ranker:
    """The model of all rows of ``train`` (quality, x), which should be ``kept``."""
    at = [F.get("x", F.lit(k)) for k in range(len(FEATURES))]
    stats = train.agg(F.count("*"), F.sum(1 - F.col("quality")), *map(F.avg, at), *map(F.stddev_pop, at)).first()
    n, bad = stats[0], stats[1] or 0
    if not 0 < bad < n:
        return unlearned()
    mean, spread = np.array(stats[2:], np.float64).reshape(2, -1)
    r = Ranker(np.zeros(len(FEATURES)), single(mean), single(np.maximum(spread, 1e-6)), 0.0)

    def sums_at(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * SLOTS, SUMS))
            for b in batches:
                slot, sums = slot_sums(r.scaled(arrays(b.column(1))), b.column(0).to_numpy(), weights)
                total[slot] += sums
            slot = np.flatnonzero(total[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1, dtype=np.int32) * SUMS), pa.array(total[slot].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(slot), lists], ["slot", "sums"])

        parts = train.mapInArrow(summed, "slot long, sums array<double>")
        t = parts.groupBy("slot").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(SUMS)]).alias("sums")).toArrow()
        slot = t.column("slot").to_numpy()
        order = np.argsort(slot)
        return slot[order], t.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, SUMS)[order]

    r.weights = learned(sums_at)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ordered(r.raw(arrays(b.column(1)))))], ["key"])

    low, high = order_statistics(kept(train.mapInArrow(keyed, "key long"), "keys"), cut_rank(n, bad))
    r.threshold = (number(low) + number(high)) / 2
    return r


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    rows = kept(featured(docs), "features")
    labels = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("long").alias("quality"))
    # merged at every size: which side is small must not decide what a larger corpus costs
    train = rows.where("not held_out").join(labels.hint("merge"), "doc_id").select("quality", "x")
    model = fit_table(kept(train, "training"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(arrays(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= AT_THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
