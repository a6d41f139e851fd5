"""Near-dedup by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, shingle sets decide.

Texts that differ in ASCII case and white space only are one class (64-bit hash of the words). Candidates are classes
whose SimHash fingerprints differ in a few bits (pivot tables, exact) or that share one of `BANDS` keys of `ROWS` MinHash
values each: a pair at exactly 0.8 is missed with a chance of (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000, a nearer one with
a smaller chance. Candidates are joined to components; within one, all pairs are compared on their whole sets of shingle
hashes, in tasks of bounded size, and only pairs of at least `least` link. Tasks send on spanning forests of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.blocks import dealt, forest, grouped, whole_groups
from inkwell.llm.common import components, materialize, utf8
from inkwell.llm.simhash import linked

BANDS, ROWS = 20, 4
_ODD = np.random.default_rng(80).integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.random.default_rng(81).integers(0, 2**64, (BANDS, ROWS), np.uint64, endpoint=False) | np.uint64(1)
SKETCH = "struct<mark:long,fp:long,bands:array<long>>"


def _shingles(text: bytes, size: int) -> tuple[int, np.ndarray]:
    """A hash of all words, and the hashes of the shingles (one of all words where they are fewer), repeats included."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        whole = xxhash.xxh64_intdigest(joined, 42)
        return whole, np.array([whole] if words else [], np.uint64)
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, to[:-1] + 1][: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return digest(joined, 42), np.fromiter([digest(joined[i:j], 42) for i, j in zip(starts, to[size - 1 :].tolist())], np.uint64, len(starts))


def _sketch(text: bytes, size: int) -> tuple[int, int, np.ndarray]:
    mark, h = _shingles(text, size)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 4096):
        own = h[i : i + 4096]
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, (own[:, None] * _ODD).min(axis=0), out=least)
    fp = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
    return mark, fp, (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def sketches(text: Column, size: int) -> Column:
    @F.arrow_udf(SKETCH)
    def sketch(column: pa.Array) -> pa.Array:
        data, starts = utf8(column)
        got = [_sketch(data[i:j].tobytes(), size) for i, j in zip(starts[:-1], starts[1:])]
        mark, fp = (pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 1))
        flat = np.concatenate([g[2] for g in got]).view(np.int64) if got else np.empty(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        return pa.StructArray.from_arrays([mark, fp, bands], ["mark", "fp", "bands"])

    return sketch(text)


def shingle_sets(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text, as bytes."""

    @F.arrow_udf("binary")
    def sets(column: pa.Array) -> pa.Array:
        data, starts = utf8(column)
        return pa.array([np.unique(_shingles(data[i:j].tobytes(), size)[1]).tobytes() for i, j in zip(starts[:-1], starts[1:])], pa.binary())

    return sets(text)


def candidates(classes: DataFrame, bits: int) -> DataFrame:
    """classes: mark, fp, bands. Rows (node, component) of the classes that have a candidate."""
    keyed = classes.select("mark", F.posexplode("bands").alias("band", "value")).select("mark", F.xxhash64("band", "value").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first < last").select("key", "first")
    met = keyed.join(shared, "key").select(F.col("mark").alias("a"), F.col("first").alias("b"))
    near = linked(classes.select(F.col("mark").alias("doc_id"), "fp"), bits).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return components(met.union(near).where("a <> b").distinct())


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets whose Jaccard similarity is at least `least`."""
    size = np.array([len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, wide = np.repeat(np.arange(len(sets)), size), often[code] > 1
    row, code = row[wide], (np.cumsum(often > 1) - 1)[code[wide]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        i, j = np.searchsorted(code, (low, low + 4096))
        held, at = np.unique(row[i:j], return_inverse=True)
        has = np.zeros((len(held), 4096), np.float32)
        has[at, code[i:j] - low] = 1
        both[np.ix_(held, held)] += has @ has.T
    total = size[:, None] + size[None, :]
    return np.nonzero(np.triu(both.astype(float) * (1 + least) >= least * total - 1e-6, 1) & (both > 0))


def _verified(least: float):
    def verified(batches):
        for t in whole_groups(batches, 1000):
            key, pair, mark = (t[c].to_numpy() for c in ("key", "pair", "mark"))
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), True])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                sets = [np.frombuffer(s.as_py(), np.uint64) for s in t["set"].slice(i, j - i)]
                root = forest(j - i, *alike(sets, least))
                some = np.flatnonzero(root != np.arange(j - i))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(mark[i:j][some]), pa.array(mark[i:j][root[some]])], ["a", "b"])

    return verified


def least_of_each(docs: DataFrame, text: str, order: Column, size: int = 5, least: float = 0.8, bits: int = 4, block: int = 512) -> DataFrame:
    """The documents, one of each group of near duplicates: the least by `order`, a struct that no two rows share."""
    own = materialize(docs.withColumns({"__sketch": sketches(F.col(text), size), "__row": F.monotonically_increasing_id()}))
    rows = own.select(F.col("__sketch.mark").alias("mark"), F.col("__sketch.fp").alias("fp"), F.col("__sketch.bands").alias("bands"), F.struct(order.alias("order"), "__row").alias("first"))
    # Rows of one mark have the same words, hence the same sketch.
    classes = materialize(rows.groupBy("mark").agg(F.min("first").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    found = candidates(classes, bits).join(classes.select(F.col("mark").alias("node"), "first.__row"), "node")
    keyed = own.select("__row", text).join(found, "__row").select(F.col("component").alias("key"), F.col("node").alias("mark"), shingle_sets(F.col(text), size).alias("set"))
    links = grouped(dealt(materialize(keyed), "mark", block).select("key", "pair", "mark", "set")).mapInArrow(_verified(least), "a long, b long")
    named = classes.select("mark", "first").join(components(links).withColumnRenamed("node", "mark"), "mark", "left")
    keep = named.groupBy(F.coalesce("component", "mark")).agg(F.min("first").alias("first")).select("first.__row")
    return own.join(keep, "__row", "left_semi").select(*docs.columns)
