"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores them.

Words are lower-cased and cut at ASCII punctuation and white space. Every n-gram of an item is a seed, rare or not: an
edited copy makes its intact n-grams frequent and leaves those it broke rare, so a choice by rarity would lose it. One
scan looks seeds up in every whole text; around the places where an item's seeds hit, the item and the text are aligned
locally (match 2, mismatch -1, gap -1) and the best score, as a share of the item's perfect score, decides: an edited
copy loses 1.5 points of 100 for each percent of its words replaced. A copy without one intact n-gram isn't seen.

The items are a stated query set: they are read in blocks of bounded size, each matched against all documents, and only
one block's tables are on the driver and sent to executors at a time. Items with under `least_words` words must be there
word for word; those with under n words have no seed and match nothing, as do null items and null or empty texts. Equal
items are all reported. Each row is a document, also one that repeats an id or has none. A very long text is read whole.
Bytes that aren't UTF-8 count as a replacement character. Empty tables give empty results. Columns with names used here
don't meet them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize

BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_CUT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
FOUND = "array<struct<item_id:long,score:double,seeds:int,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("seeds", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass").translate(_CUT).split()


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two id sequences (match 2, mismatch -1, gap -1): score, and the ends in x and y of a best alignment."""
    slope = np.arange(len(y) + 1)
    row, best = np.zeros(len(y) + 1, np.int64), (0, 0, 0)
    for i, a in enumerate(x):
        own = np.maximum(row - 1, 0)
        own[1:] = np.maximum(own[1:], row[:-1] + np.where(y == a, 2, -1))
        row = np.maximum.accumulate(own + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


@dataclass
class Block:
    """Items of a block: ids, word ids (0: none of its words), sorted codes of n-grams, and for each code its (item, offset) places."""

    n: int
    least_words: int
    ids: list[int | None]
    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    codes: np.ndarray
    first: np.ndarray
    place_item: np.ndarray
    place_at: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]], n: int, least_words: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        kept = [(i, w) for i, t in rows if t is not None and len(w := words(t)) >= n]
        items = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64) for _, w in kept]
        block = cls(n, least_words, [i for i, _ in kept], vocabulary, items, np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), np.empty(0, int))
        if items:
            coded = [block.coded(x) for x in items]
            codes = np.concatenate(coded)
            item = np.repeat(np.arange(len(items)), [len(c) for c in coded])
            at = np.concatenate([np.arange(len(c)) for c in coded])
            order = np.argsort(codes, kind="stable")
            block.codes, first = np.unique(codes[order], return_index=True)
            block.first = np.r_[first, len(codes)]
            block.place_item, block.place_at = item[order], at[order]
        return block

    def coded(self, ids: np.ndarray) -> np.ndarray:
        """A code for each n-gram of word ids; codes with a word outside the vocabulary are all ones."""
        k = len(ids) - self.n + 1
        if k <= 0:
            return np.empty(0, np.uint64)
        code, inside = np.zeros(k, np.uint64), np.ones(k, bool)
        base = np.uint64(len(self.vocabulary) + 1)  # three ids of up to 2**21 words fit 64 bits; larger blocks would wrap, and hits are aligned anyway
        with np.errstate(over="ignore"):
            for j in range(self.n):
                code = code * base + ids[j : j + k].astype(np.uint64)
                inside &= ids[j : j + k] > 0
        return np.where(inside, code, np.uint64(2**64 - 1))

    def read(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        w = words(text)
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text, and numbers of the codes found there."""
        code = self.coded(ids)
        some = np.flatnonzero(code != np.uint64(2**64 - 1))
        if not len(some) or not len(self.codes):
            return some[:0], some[:0]
        where = np.minimum(np.searchsorted(self.codes, code[some]), len(self.codes) - 1)
        good = self.codes[where] == code[some]
        return some[good], where[good]

    def matches(self, text: bytes, least: float) -> list[dict]:
        ids = self.read(text)
        at, code = self.hits(ids)
        if not len(at):
            return []
        n = self.first[code + 1] - self.first[code]
        place = np.repeat(self.first[code] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, begin = self.place_item[place], np.repeat(at, n) - self.place_at[place]
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        cut = np.flatnonzero(np.r_[True, np.diff(item) > 0, True])
        out = []
        for i, j in zip(cut[:-1], cut[1:]):
            x, starts = self.items[item[i]], begin[i:j]
            half = len(x) // 2 + 1
            apart = np.flatnonzero(np.diff(starts) > len(x) + 2 * half)
            best = (0, 0, 0)
            for a, b in zip(np.r_[0, apart + 1], np.r_[apart, len(starts) - 1]):
                low = max(0, starts[a] - half)
                score, ex, ey = align(x, ids[low : starts[b] + len(x) + half])
                best = max(best, (score, ex, low + ey))
            share = best[0] / (2 * len(x))
            if share >= (least if len(x) >= self.least_words else 1):
                low = max(0, best[2] - 3 * len(x))
                back = align(x[: best[1]][::-1], ids[low : best[2]][::-1])
                out.append({"item_id": self.ids[item[i]], "score": share, "seeds": int(j - i), "start": int(best[2] - back[2]), "end": int(best[2])})
        return out


def blocks(items: DataFrame, item_id: str = "item_id", item_text: str = "text", n: int = 3, least_words: int = 8) -> Iterator[tuple[Broadcast, bool]]:
    """Blocks of items with their seeds, sent to executors one after the other, and whether a block is the only one.

    A block is let go of when the next is asked for: what reads it has to be written by then.
    """
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    count = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil(size["bytes"] / BLOCK_BYTES))
    for k in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        block = Block.of(sorted(((r[0], bytes(r[1])) for r in own), key=lambda r: (r[0] is None, r[0], r[1])), n, least_words)
        if block.items:
            shared = items.sparkSession.sparkContext.broadcast(block)
            yield shared, count == 1
            if count > 1:
                shared.unpersist()


def found(shared: Broadcast, text: Column, least: float = 0.5) -> Column:
    """The items of a block that a text holds: an array of (item_id, score, seeds, start, end), start and end in words."""

    @F.arrow_udf(FOUND)
    def matched(column: pa.Array) -> pa.Array:
        block = shared.value
        return pa.array([block.matches(t, least) if (t := x.as_py()) else [] for x in column.cast(pa.binary())], _FOUND)

    return matched(text)


def passages(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", least: float = 0.5, **chosen) -> DataFrame:
    """A row (keep, item_id, score, seeds, start, end) for each document and item that it holds."""
    parts = []
    for shared, alone in blocks(items, **chosen):
        part = docs.select(*keep, F.explode(found(shared, F.col(text), least)).alias("m")).select(*keep, "m.*")
        parts.append(part if alone else materialize(part))
    none = docs.select(*keep, F.explode(F.array().cast(FOUND)).alias("m")).select(*keep, "m.*")
    return reduce(DataFrame.unionByName, parts) if parts else none


def clean(docs: DataFrame, items: DataFrame, text: str = "text", least: float = 0.5, **chosen) -> DataFrame:
    """The documents that hold no item."""
    for shared, alone in blocks(items, **chosen):
        docs = docs.where(F.size(found(shared, F.col(text), least)) == 0)
        docs = docs if alone else materialize(docs)
    return docs
