"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear hinge-loss model fit by dual coordinate descent.

Features are hashed indicators over the whole text: character 1- to 4-grams (bytes), words (letters only) and word pairs.
A margin becomes a probability by a logistic curve fit on margins of rows kept out of the descent.

Null texts count as empty: no feature, the score of the bias. Null labels are never learned; several labels of one id
count as the smallest. Rows repeat and tie freely: a row is scored by its text alone. With no or one label the score is
that label's share of the rows learned (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SLICE_BYTES, utf8

BITS = 16
#: Bytes of a word that its hash tells.
LONGEST = 64
_POWERS = np.cumprod(np.full(LONGEST, 0x01000193, np.uint32), dtype=np.uint32)


def _words(part: np.ndarray, low: np.ndarray, count: int) -> np.ndarray:
    """Hashes of the words that start in bytes 1 to count of a view (byte 0 is the one before): prefix polynomials of their first LONGEST bytes."""
    starts = np.flatnonzero(part[1:] & ~part[:-1]) + 1
    own = int(np.searchsorted(starts, count, "right"))
    if not own:
        return np.empty(0, np.uint32)
    at = np.arange(len(part)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(part)]))
    mixed = np.where(part & (at < LONGEST), low * _POWERS[np.minimum(at, LONGEST - 1)], np.uint32(0))
    return np.add.reduceat(mixed, starts, dtype=np.uint32)[:own]


def _features(text: np.ndarray) -> np.ndarray:
    """Buckets present in one text, ascending. The text is read in slices, so that its length costs no memory."""
    flags, before = np.zeros(1 << BITS, bool), np.empty(0, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(text), SLICE_BYTES):
            count = min(SLICE_BYTES, len(text) - a)
            b = text[a : a + count + 3].astype(np.uint32)
            flags[b[:count]] = True
            for n, odd in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
                if len(b) >= n:
                    packed = b[: len(b) - n + 1].copy()
                    for k in range(1, n):
                        packed = (packed << np.uint32(8)) | b[k : len(b) - n + 1 + k]
                    flags[(packed * np.uint32(odd)) >> np.uint32(32 - BITS)] = True
            view = text[max(a - 1, 0) : a + count + LONGEST]
            view = view if a else np.r_[np.uint8(32), view]
            low = view | np.uint8(0x20)
            words = _words(((low >= 97) & (low <= 122)) | (view >= 128), low.astype(np.uint32), count)
            flags[(words * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)] = True
            words = np.r_[before, words]
            flags[((words[:-1] * np.uint32(31) + words[1:]) * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)] = True
            before = words[-1:]
    return np.flatnonzero(flags)


@dataclass
class QualityModel:
    """weights of the buckets (ratios times hinge weights), bias, and the logistic curve's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        margin = np.array([self.weights[f].sum() / max(1.0, len(f)) ** 0.5 for f in (_features(data[i:j]) for i, j in zip(starts[:-1], starts[1:]))], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _listed(batches):
    for batch in batches:
        data, starts = utf8(batch.column(batch.schema.get_field_index("text")))
        label = batch.column(batch.schema.get_field_index("label")).to_pylist()
        for i, x in enumerate(label):
            yield pa.RecordBatch.from_pydict({"label": [x], "ids": [_features(data[starts[i] : starts[i + 1]]).astype(np.int32)]}, pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32()))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, penalty: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 11) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, label (0 or 1), an id once at most.

    Learns from a bounded sample, `sample` ids of each label at most, by hash of the id. Those ids are broadcast to the
    scan of the documents: their number is the bound, and texts needn't be shuffled.
    """
    parts = [labels.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for x in (0, 1)]
    few = parts[0].union(parts[1]).select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label").mapInArrow(_listed, "label int, ids array<int>").toArrow().to_pandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows.label[i], len(rows.ids[i]), rows.ids[i].tobytes()))].reset_index(drop=True)
    y = np.where(rows.label == 1, 1.0, -1.0) if len(rows) else np.zeros(0)
    size = 1 << BITS
    if not len(y) or abs(y.sum()) == len(y):
        share = float((y > 0).mean()) if len(y) else 0.5
        return QualityModel(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))))
    x = [np.asarray(v) for v in rows.ids]
    random = np.random.default_rng(seed)
    held = random.random(len(y)) < 0.25
    if not ((y[~held] > 0).any() and (y[~held] < 0).any()):
        held[:] = False
    learn = np.flatnonzero(~held)
    counts = np.full((2, size), smooth)
    for i in learn:
        counts[int(y[i] > 0), x[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # min |w|^2/2 + C sum max(0, 1 - y w.x): one dual variable at a time, each class with the same total penalty.
    cost = {s: penalty * len(learn) / (2 * max(1, int((y[learn] == s).sum()))) for s in (-1.0, 1.0)}
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    scaled = [ratio[f] / max(1.0, len(f)) ** 0.5 for f in x]
    norm = np.array([v @ v + 1.0 for v in scaled])
    for _ in range(epochs):
        for i in random.permutation(learn):
            slope = y[i] * (w[x[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[y[i]])
            if new != alpha[i]:
                w[x[i]] += (new - alpha[i]) * y[i] * scaled[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    check = np.flatnonzero(held) if held.any() else learn
    margin = np.array([w[x[i]] @ scaled[i] for i in check]) + bias
    a, c, t = 1.0, 0.0, (y[check] > 0) * 1.0
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):  # Newton steps of Platt's curve
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g, v = p - t, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * c]))
        a, c = a - step[0], c - step[1]
    return QualityModel((w * ratio).astype(np.float32), float(bias), float(max(a, 0.0)), float(c))


def scored(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 of a text column."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(*utf8(column)), pa.float64())

    return score(text)
