"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy, with calibrated rejection.

A document is the mean of the embeddings of its byte 3- and 4-grams (letters only, ASCII and Latin-1 case folded, any
other byte a word end). The mean runs over the whole text. As everything after the mean is linear, prediction folds the
embeddings and the softmax weights into one table of a few columns and sums its rows.

Nulls and texts without a letter are `und` with score 0 and are rejected. Rows repeat, tie and miss ids freely: each
row is predicted by its text alone, copies are learned once. A very long text is read whole, in slices. Null labels are
never learned; without labelled rows every text is `und`, and an empty table gives an empty result. Other columns, of
whatever names, aren't read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import pieces, row_sums, utf8

UND = "und"
BITS = 14


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with case folded and everything that isn't a letter (bytes over 127 count as letters) turned to a space."""
    to = np.full(256, 32, np.uint8)
    to[97:123] = to[65:91] = np.arange(97, 123)
    to[128:] = np.arange(128, 256)
    out = to[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = second[(data[second] >= 0x80) & (data[second] <= 0x9E)]
    out[upper] += 0x20
    return out


def _buckets(data: np.ndarray, starts: np.ndarray):
    """For n of 3 and 4: the bucket of the n-gram at each byte, 2**BITS for none (crosses a document's end or a word's)."""
    b = _folded(data).astype(np.uint32)
    last = starts[1:][starts[1:] > starts[:-1]] - 1
    for n, odd in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        if len(b) < n:
            continue
        packed = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            packed = (packed << np.uint32(8)) | b[k : len(b) - n + 1 + k]
        h = ((packed * np.uint32(odd)) >> np.uint32(32 - BITS)).astype(np.int32)
        none = b[1 : len(b) - n + 2] == 32
        for k in range(2, n - 1):
            none |= b[k : len(b) - n + 1 + k] == 32
        for k in range(n - 1):
            cut = last - k
            none[cut[(cut >= 0) & (cut < len(none))]] = True
        h[none] = 1 << BITS
        yield h


def _sliced(data: np.ndarray, starts: np.ndarray):
    """First and end row, buckets of the n-grams that start there, and where each row starts, slice by slice."""
    for i, j, low, high in pieces(data, starts):
        end = min(high + 3, int(starts[j]))
        own = np.clip(starts[i : j + 1], low, end) - low
        for h in _buckets(data[low:end], own):
            yield i, j, h[: high - low], own


def _has_letter(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    has = row_sums(ascii_letter[data], starts) > 0
    for i in np.flatnonzero(~has):
        if starts[i + 1] > starts[i]:
            text = data[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace")
            has[i] = any(unicodedata.category(c)[0] == "L" for c in set(text))
    return has


@dataclass
class LanguageModel:
    """languages; folded: embeddings times softmax weights, a row for each bucket (the last is zero); bias; temperature; floor: calibrated confidence below which a text is rejected."""

    languages: list[str]
    folded: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0

    def predict(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, k = len(starts) - 1, len(self.languages)
        if not k:
            return [UND] * n, np.zeros(n)
        rows = np.c_[self.folded, np.r_[np.ones(len(self.folded) - 1), 0]].astype(np.float32)
        sums = np.zeros((n, k + 1))
        for i, j, h, own in _sliced(data, starts):
            sums[i:j] += row_sums(rows[h], np.minimum(own, len(h)))
        logits = (sums[:, :k] / np.maximum(sums[:, k:], 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        has = _has_letter(data, starts)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else UND for b, ok in zip(best, has)], np.where(has, p[np.arange(n), best], 0.0)


def _sample(df: DataFrame, per_language: int) -> DataFrame:
    """Texts with their labels, `per_language` different texts of each label at most: those with the least hashes.

    A share of hashes that holds about twice as many is read first, copies meet before the shuffle, and a rank among
    what is left sets the bound, so neither a label's rows nor a text's copies are one task's work.
    """
    rows = df.where("label IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    share = {r["label"]: min(1.0, 2 * per_language / r["n"]) for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not share:
        return rows.select("label", "text").limit(0)
    odds = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    few = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(odds, F.col("label")) * (1 << 40)).groupBy("label", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("label", "text")


def _counted(batches):
    for batch in batches:
        data, starts = utf8(batch.column(batch.schema.get_field_index("text")))
        label = batch.column(batch.schema.get_field_index("label")).to_pylist()
        for i, x in enumerate(label):
            n = np.zeros((1 << BITS) + 1, np.int64)
            own = data[starts[i] : starts[i + 1]]
            for _, _, h, _ in _sliced(own, np.array([0, len(own)])):
                n += np.bincount(h, minlength=len(n))
            ids = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_pydict({"label": [x], "ids": [ids.astype(np.int32)], "n": [n[ids].astype(np.int32)]}, pa.schema([("label", pa.string()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))


def fit(df: DataFrame, text: str | Column, label: str | Column, per_language: int = 400, dim: int = 12, epochs: int = 6, rate: float = 0.5, lost: float = 0.001, most_floor: float = 0.4, seed: int = 7) -> LanguageModel:
    """Learn from a bounded sample, `per_language` different texts of each label at most (the only bound; they are read whole).

    A quarter of the sample is kept out of SGD for calibration: the temperature that minimizes log loss, and the floor
    of confidence that `lost` of correctly predicted texts fall below (`most_floor` at most).
    """
    got = _sample(df.select(F.col(text).alias("text") if isinstance(text, str) else text.alias("text"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label")), per_language)
    rows = got.mapInArrow(_counted, "label string, ids array<int>, n array<int>").toArrow().to_pandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows.label[i], len(rows.ids[i]), rows.n[i].tobytes(), rows.ids[i].tobytes()))].reset_index(drop=True)
    languages = sorted(set(rows.label))
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0))
    random = np.random.default_rng(seed)
    at = {x: i for i, x in enumerate(languages)}
    x = [(np.asarray(i), np.asarray(n, float) / max(1, np.sum(n))) for i, n in zip(rows.ids, rows.n)]
    y = np.array([at[v] for v in rows.label])
    held = random.random(len(y)) < 0.25
    table = random.uniform(-1, 1, (1 << BITS, dim))
    weights, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(learn):
            ids, c = x[i]
            mean = c @ table[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            table[ids] -= step * len(ids) ** 0.5 * np.outer(c, back)
    folded = np.vstack([table @ weights, np.zeros(len(languages))])
    check = np.flatnonzero(held) if held.any() else learn
    z = np.array([x[i][1] @ folded[x[i][0]] for i in check]) + bias

    def chances(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    heat = min((2.0**k for k in np.arange(-4, 4, 0.25)), key=lambda t: -np.log(np.maximum(chances(t)[np.arange(len(check)), y[check]], 1e-12)).sum() + 1e-6 * abs(np.log2(t)))
    p = chances(heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    floor = min(most_floor, float(np.quantile(right, lost))) if len(right) else 0.0
    return LanguageModel(languages, folded.astype(np.float32), bias, float(heat), floor)


def predicted(model: LanguageModel, text: Column) -> Column:
    """struct(lang string, score double, rejected boolean) of a text column; evaluated once however often it is read."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        lang, score = model.predict(*utf8(column))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array((score < model.floor) | (np.array(lang, object) == UND), pa.bool_())], ["lang", "score", "rejected"])

    # Marked so that a filter on the answer isn't pushed below it and asks a second time.
    return predict.asNondeterministic()(text)
