"""What a set of chunks holds and whether it is enough to rest on: totals, sample-size advice, names, profile versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.ranges import LEAST_DOCUMENTS, LEAST_PIECES

ENOUGH_DOCUMENTS, ENOUGH_CHUNKS, ENOUGH_WORDS = 2, 15, 20_000


def totals(chunks: DataFrame) -> DataFrame:
    """chunks: document, words. One row (chunks, documents, words)."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("document").alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))


def thin(chunks: DataFrame) -> DataFrame:
    """(code, found, wanted): a row for each reason not to trust a reference of these chunks (document, words); none for a good one.

    dominant: one document holds most chunks, and what the others hold is too little to judge it by.
    """
    sizes = chunks.groupBy("document").agg(F.count("*").alias("c"), F.coalesce(F.sum("words"), F.lit(0)).alias("w"))
    all_ = sizes.agg(F.count("*").alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.coalesce(F.max("c"), F.lit(0)).alias("largest"))
    rest = F.col("chunks") - F.col("largest")
    few = (rest < LEAST_PIECES) | (F.col("documents") < LEAST_DOCUMENTS)
    note = lambda code, found, wanted, when: F.when(when, F.struct(F.lit(code).alias("code"), found.cast("long").alias("found"), F.lit(wanted).cast("long").alias("wanted")))
    notes = [
        note("documents", F.col("documents"), ENOUGH_DOCUMENTS, F.col("documents") < ENOUGH_DOCUMENTS), note("chunks", F.col("chunks"), ENOUGH_CHUNKS, F.col("chunks") < ENOUGH_CHUNKS),
        note("dominant", rest, LEAST_PIECES, (F.col("documents") >= ENOUGH_DOCUMENTS) & (F.col("largest") > rest) & few), note("words", F.col("words"), ENOUGH_WORDS, F.col("words") < ENOUGH_WORDS),
    ]
    return all_.select(F.explode(F.array_compact(F.array(*notes))).alias("n")).select("n.*")


def repeated_names(texts: DataFrame, name: str, path: str) -> DataFrame:
    """(name, inputs, texts): names that several inputs claim, or one input twice."""
    got = texts.groupBy(F.col(name).alias("name")).agg(F.countDistinct(path).alias("inputs"), F.count("*").alias("texts"))
    return got.where("name IS NOT NULL AND texts > 1")


def numbered(texts: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """texts with unique: the name, from the second text on with its number, `x (2)`."""
    at = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return texts.withColumn("unique", F.when(at > 1, F.concat(F.col(name), F.lit(" ("), at, F.lit(")"))).otherwise(F.col(name)))


def check_version(held: int | None, minor: int | None, expected: int, name: str) -> None:
    """The major version must be the one that this code writes; minor ones only add."""
    numbers = [type(x) is int for x in (held, 0 if minor is None else minor)]
    if not all(numbers) or held < 1 or (minor or 0) < 0:
        raise ValueError(f"{name} has no version that can be read")
    if held != expected:
        raise ValueError(f"{name} was made by {'a newer' if held > expected else 'an older'} version ({held}; this one reads {expected})")
