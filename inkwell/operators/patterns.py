"""Pattern distributions and their divergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "<other>"


def counted(patterns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pattern, n)."""
    return patterns.groupBy(*by, "pattern").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, by: Sequence[str], k: int = 300) -> DataFrame:
    """(by, pattern, share): the k most frequent patterns (ties by pattern), the rest as one.

    Each task sends on its own k at most of a group (a limit, or a ranked filter, before the shuffle); the rest is the
    total minus what the top holds.
    """
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "pattern"))
        top = counts.withColumn("r", rank).where(F.col("r") <= k).drop("r")
        rows = top.join(total, list(by))
        rest = total.join(top.groupBy(*by).agg(F.sum("n").alias("held")), list(by))
    else:
        top = counts.orderBy(F.desc("n"), "pattern").limit(k)
        rows = top.crossJoin(F.broadcast(total))  # one row
        rest = total.crossJoin(F.broadcast(top.agg(F.sum("n").alias("held"))))  # one row
    rest = rest.where("total > held").select(*by, F.lit(OTHER).alias("pattern"), (F.col("total") - F.col("held")).alias("n"), "total")
    every = rows.select(*by, "pattern", "n", "total").unionByName(rest).withColumn("share", F.col("n") / F.col("total"))
    return every.where(f"pattern <> '{OTHER}' OR share > 1e-12").select(*by, "pattern", "share")


def collapsed(shares: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    """shares with patterns that `known` doesn't have as one."""
    rows = shares.join(known.select("pattern").withColumn("known", F.lit(True)), "pattern", "left")
    return rows.withColumn("pattern", F.when(F.col("known"), F.col("pattern")).otherwise(OTHER)).groupBy(*by, "pattern").agg(F.sum("share").alias("share"))


def divergence(sample: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, divergence): Jensen-Shannon in bits between each sample distribution and one reference.

    What the reference alone has adds half its share: it is the rest of 1, so no full outer join for each sample.
    """
    q = F.coalesce("q", F.lit(0.0))
    m = (F.col("share") + q) / 2
    rows = sample.join(reference.select("pattern", F.col("share").alias("q")), "pattern", "left")
    part = F.col("share") * F.log2(F.col("share") / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return rows.where("share > 0").groupBy(*by).agg((F.sum(part) / 2).alias("both"), F.sum(q).alias("seen")).select(*by, F.greatest(F.lit(0.0), F.col("both") + (1 - F.col("seen")) / 2).alias("divergence"))
