"""Candidate buckets as tasks of bounded size: what similarity joins by shared keys have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(keyed: DataFrame, item: str, block: int) -> DataFrame:
    """keyed: key long, an item column and others. Rows of keys that two items or more share, with `pair` and `own`.

    A bucket of up to `block` rows is one group. A larger one is cut into blocks by a hash of the item, and each pair of
    blocks is a group, so no group has over about 2 * block rows and each pair of items meets in exactly one group:
    items of one block where own is the same, of two blocks where it differs. Groups are (key, pair).
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("bucket")).where("bucket > 1")
    cuts = F.ceil(F.col("bucket") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(item), F.col("cuts")).cast("int")
    rows = keyed.join(sizes, "key").withColumn("cuts", cuts).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    rows = rows.select("*", other.alias("other"))
    return rows.withColumn("pair", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).drop("bucket", "cuts", "other")


def grouped(rows: DataFrame) -> DataFrame:
    """Deals groups to tasks, each group's rows in a row."""
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches, of about `least` rows or one larger group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < least:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        key, pair = table["key"].to_numpy(), table["pair"].to_numpy()
        cut = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
        if len(cut):
            yield table.slice(0, cut[-1] + 1)
            kept = table.slice(cut[-1] + 1).to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def ends(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns, the end of its run of equal values."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n items by the pairs (left[i], right[i])."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label
