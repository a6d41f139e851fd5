"""Edited texts and their originals: what is covered, what has no partner, edits of texts that were dropped as repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hits(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with hit: whether one of others has one of their keys that isn't null. An equi-join for each key."""
    out = rows
    for i, k in enumerate(keys):
        known = others.where(F.col(k).isNotNull()).select(F.col(k).alias(f"__k{i}")).distinct().withColumn(f"__h{i}", F.lit(True))
        out = out.join(known, F.col(k) == F.col(f"__k{i}"), "left")
    return out.select(*rows.columns, F.coalesce(*[f"__h{i}" for i in range(len(keys))], F.lit(False)).alias("hit"))


def covered(originals: DataFrame, edited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Originals that an edited text shares one of the keys with."""
    return _hits(originals, edited, keys).where("hit").drop("hit")


def unmatched(edited: DataFrame, originals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edited texts without an original: an error in an evaluation. With the sides swapped, originals without an edit: a warning."""
    return _hits(edited, originals, keys).where("NOT hit").drop("hit")


def edits_of_repeats(edited: DataFrame, repeats: DataFrame) -> DataFrame:
    """edited: id, key (its original's). repeats: dropped, kept (keys of originals; kept null where it is another set's).

    (id, key, pair, note): pair is the original to compare with, null where the edit is left out. An edit of a dropped
    text is one of the copy kept. Of a kept text one edit counts: its own, else the first by id. note: own, copy,
    doubled, outside.
    """
    once = repeats.groupBy("dropped").agg(F.min("kept").alias("kept"), F.count_distinct(F.coalesce(F.col("kept").cast("string"), F.lit(""))).alias("n")).where("n = 1").drop("n")
    rows = edited.select("id", "key").join(once.withColumnRenamed("dropped", "key").withColumn("repeat", F.lit(True)), "key", "left")
    own = rows.where("repeat IS NULL").select(F.col("key").alias("kept"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("kept").orderBy("id")) == 1
    copies = rows.where("repeat AND kept IS NOT NULL").withColumn("first", first).join(own, "kept", "left")
    copies = copies.withColumn("note", F.when(F.col("taken").isNull() & F.col("first"), "copy").otherwise("doubled"))
    parts = [
        rows.where("repeat IS NULL").select("id", "key", F.col("key").alias("pair"), F.lit("own").alias("note")),
        copies.select("id", "key", F.when(F.col("note") == "copy", F.col("kept")).alias("pair"), "note"),
        rows.where("repeat AND kept IS NULL").select("id", "key", F.col("kept").alias("pair"), F.lit("outside").alias("note")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
