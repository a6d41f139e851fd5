"""Shared pieces of the training-data operators: Arrow text buffers, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import tables
from inkwell.sources.scratch import discard, materialize

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once in a Python worker; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, back to back, and each row's start (with the end of the last); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    _, where, data = column.buffers()
    starts = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one longer row."""
    at, n = 0, len(starts) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def pieces(data: np.ndarray, starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """slices with their bytes, (first row, end row, low, high); a longer row comes in several pieces, cut between characters."""
    for i, j in slices(starts, most):
        low, end = int(starts[i]), int(starts[j])
        while end - low > most:
            high = low + most
            while high > low + 1 and data[high] & 0xC0 == 0x80:
                high -= 1
            yield i, j, low, high
            low = high
        yield i, j, low, end


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]] (along axis 0), 0 for empty rows."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest reachable node.

    Alternates large-star and small-star rounds until nothing changes (about the square of the longest path's logarithm):
    every round is joins and grouped minima with map-side combine. The minima are dealt anew before a join, so both its
    sides are plain shuffles and a node with a third of all edges is split by AQE like any skewed key. A round's edges are
    written to the shared folder, the round's before are deleted.
    Nodes without edges are absent. Null ends and loops count as no edge; no edges give an empty table.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: smaller neighbours, and the node itself, move to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).hint("rebalance")
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, now = now, materialize(moved.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        discard(before)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = mark
