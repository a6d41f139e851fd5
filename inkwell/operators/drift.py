"""Paragraph drift: overlapping spans of whole paragraphs, each paragraph's statistic, the null's tail, thresholds, flags."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions.tokens import WORD
from inkwell.operators.ranges import DELTA_FLOOR, LIKENESS_FLOOR

SPAN, ALPHA, TAIL_SHARE, LEAST_TAIL, LEAST_DOCUMENTS, LEVEL_SHARE, MINIMUM = 100, 0.05, 0.1, 20, 10, 0.9, 1.0


def excerpt(text: Column, limit: int = 60) -> Column:
    """The first characters, cut at a word."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(t, 1, limit + 1)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    cut = F.when(F.length(cut) >= limit // 2, cut).otherwise(F.substring(t, 1, limit))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("…")))


def paragraphs(docs: DataFrame, key: str = "chunk_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """(key, pos, line, words, excerpt, text): the parts of plain texts that hold a word, pos from 0, line from 1."""
    each = docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("line", "text")).withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("long")).where("words > 0")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    return each.select(key, pos.alias("pos"), (F.col("line") + 1).alias("line"), "words", excerpt(F.col("text")).alias("excerpt"), "text")


_SPANS = "array<struct<a1:int,b1:int,a2:int,b2:int>>"


def _spans(sizes: list[int], length: int) -> list[tuple[int, int, int, int]] | None:
    sums = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    n = len(sizes)
    if not n or sums[-1] < length:
        return None
    at = np.arange(n)
    # Ends ahead and starts behind by binary search in the sums; n + 1 and -1 where the text runs out.
    ahead = np.searchsorted(sums, sums[:-1] + length)
    behind = np.searchsorted(sums, sums[1:] - length, "right") - 1
    last, first = int(np.searchsorted(sums, sums[-1] - length, "right")) - 1, int(np.searchsorted(sums, length))
    a1, b1 = np.where(ahead <= n, at, last), np.where(ahead <= n, ahead, n)
    a2, b2 = np.where(behind >= 0, behind, 0), np.where(behind >= 0, at + 1, first)
    size = np.r_[np.asarray(sizes, float), np.inf]
    before, after = np.where(a1 > 0, size[np.maximum(a1 - 1, 0)], np.inf), size[np.minimum(b1, n)]
    same = (a1 == a2) & (b1 == b2)
    left, right = same & (before < after), same & (before >= after) & np.isfinite(after)
    return np.stack([a1, b1, a2 - left, b2 + right], axis=1).tolist()


def plan(sizes: Column, length: int = SPAN) -> Column:
    """For each paragraph of an array of word counts its two spans: array of struct(a1, b1, a2, b2), ends exclusive, null under `length` words.

    The shortest run of whole paragraphs from it on that holds `length` words, and the shortest back from it; where the
    text runs out, the text's last or first such run. Two equal spans become two by one more paragraph, the smaller
    neighbour. Runs are found by binary search in prefix sums.
    """
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("a1", "b1", "a2", "b2")]))

    @F.arrow_udf(_SPANS)
    def planned_spans(column: pa.Array) -> pa.Array:
        rows = [_spans(x or [], length) for x in column.to_pylist()]
        return pa.array([r and [dict(zip(("a1", "b1", "a2", "b2"), p)) for p in r] for r in rows], kind)

    return planned_spans(sizes)


def planned(parts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pos, a1, b1, a2, b2) of paragraphs. A document's word counts alone are gathered."""
    own = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("p"))
    got = own.select(key, F.posexplode(plan(F.transform("p", lambda x: x["words"]))).alias("pos", "s"))
    return got.select(key, "pos", "s.*")


def spans(plans: DataFrame, parts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, a, b, text): the distinct spans, with their paragraphs joined by blank lines."""
    each = plans.select(key, F.explode(F.array(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")))).alias("s")).select(key, "s.*").distinct()
    inside = each.withColumn("pos", F.explode(F.sequence(F.col("a"), F.col("b") - 1))).join(parts.select(key, "pos", "text"), [key, "pos"])
    return inside.groupBy(key, "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def statistics(plans: DataFrame, scores: DataFrame, key: str = "chunk_id") -> DataFrame:
    """scores: key, a, b, relative. (key, pos, relative, spans, a, b): the lower of a paragraph's spans, and how many were judged."""
    each = plans.select(key, "pos", F.explode(F.array_distinct(F.array(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b"))))).alias("s")).select(key, "pos", "s.*")
    got = each.join(scores.where("relative IS NOT NULL"), [key, "a", "b"])
    low = F.min(F.struct("relative", "a", "b"))
    return got.groupBy(key, "pos").agg(low.alias("m"), F.count("*").alias("spans")).select(key, "pos", "m.relative", "spans", "m.a", "m.b")


def levels(statistic: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, level): the median statistic of a document's paragraphs on two spans."""
    return statistic.where("spans = 2").groupBy(key).agg(F.median("relative").alias("level"))


def fit_tail(values: DataFrame, value: str = "value", buckets: int = 4096) -> DataFrame:
    """One row (count, threshold, share, scale): the tenth of values that lie highest, as an exponential; null with under 20 there."""
    n = values.agg(F.count(value).alias("count"))
    above = F.floor(F.col("count") * TAIL_SHARE)
    share = F.when(F.col("count") > 1, (F.col("count") - above - 1) / (F.col("count") - 1)).otherwise(F.lit(0.0))
    start = stats.nearest_rank(values.crossJoin(F.broadcast(n.select("count", share.alias("q")))).withColumnRenamed(value, "value"), ("count", "q"), {"threshold": F.col("q")})
    counts = values.groupBy(value).agg(F.count("*").alias("c"))
    over = counts.crossJoin(F.broadcast(start)).groupBy("count", "threshold").agg(F.sum(F.when(F.col(value) > F.col("threshold"), F.col("c") * (F.col(value) - F.col("threshold"))).otherwise(0.0)).alias("excess"))
    scale = F.greatest(F.col("excess") / above, F.lit(1e-6))
    return over.select("count", "threshold", (above / F.col("count")).alias("share"), scale.alias("scale")).where(F.floor(F.col("count") * TAIL_SHARE) >= LEAST_TAIL)


def limit(tail: dict[str, float], count: Column, alpha: float = ALPHA) -> Column:
    """The value that a document of so many paragraphs passes by chance with a probability of alpha at most."""
    freedom = 2 * max(round(tail["count"] * tail["share"]), 1)
    step = 2 / (9 * freedom)
    scale = tail["scale"] * freedom / (freedom * (1 - step - stats.UPPER_Z * math.sqrt(step)) ** 3)
    chance = alpha / F.greatest(count, F.lit(1))
    return F.when(chance >= tail["share"], F.lit(tail["threshold"])).otherwise(tail["threshold"] + scale * F.log(tail["share"] / chance))


def judged_spans(scores: DataFrame) -> DataFrame:
    """scores: judged, delta, p95, likeness and l_p95 (null without a contrast set). Adds by and relative: the score over its
    bound, of likeness where it has a range at the span's length, else of delta; null where the span isn't judged."""
    good = F.coalesce(F.col("judged") & F.col("p95").isNotNull() & F.col("delta").isNotNull(), F.lit(False))
    liked = good & F.col("l_p95").isNotNull() & F.col("likeness").isNotNull()
    relative = F.when(liked, F.col("likeness") / F.greatest("l_p95", F.lit(LIKENESS_FLOOR))).otherwise(F.col("delta") / F.greatest("p95", F.lit(DELTA_FLOOR)))
    return scores.withColumns({"by": F.when(liked, "likeness").otherwise("delta"), "relative": F.when(good, relative)})


def calibrated(statistic: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The null of held-out reference documents, each read in parts: one row (documents, paragraphs, median, high, count, threshold, share, scale).

    A paragraph on two spans has its document's level and an excess over it: the spread of the levels, and the tail of
    the excess. All but counts are null under LEAST_DOCUMENTS documents, the tail where it can't be fit.
    """
    own = levels(statistic, key)
    excess = statistic.where("spans = 2").join(own, key).select((F.col("relative") - F.col("level")).alias("value"))
    size = statistic.agg(F.count_distinct(key).alias("documents"), F.count("*").alias("paragraphs"))
    spread = stats.nearest_rank(own.withColumnRenamed("level", "value").withColumn("__one", F.lit(1)), ("__one",), {"median": F.lit(0.5), "high": F.lit(LEVEL_SHARE)}).drop("__one")
    got = size.join(spread, F.lit(True), "left").join(fit_tail(excess), F.lit(True), "left")  # one row each
    enough = F.col("documents") >= LEAST_DOCUMENTS
    return got.select("documents", "paragraphs", *[F.when(enough, F.col(c)).alias(c) for c in ("median", "high", "count", "threshold", "share", "scale")])


def traits(z: DataFrame, values: DataFrame, summary: DataFrame, keep: tuple[str, ...] = ("chunk_id", "pos"), k: int = 3) -> DataFrame:
    """(keep, grp, metric, z, value, reference, rank): what sets a paragraph apart, the largest z (over `scale` if z has one), zeros left out."""
    scaled = F.col("z") / (F.col("scale") if "scale" in z.columns else F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy(*keep).orderBy(F.desc(F.abs("z")), "grp", "metric"))
    top = z.withColumn("z", scaled).withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("z") != 0))
    got = top.join(values.select(*keep, "grp", "metric", "value"), [*keep, "grp", "metric"], "left").join(summary.select("grp", "metric", F.col("mean").alias("reference")), ["grp", "metric"], "left")
    return got.select(*keep, "grp", "metric", "z", "value", "reference", "rank")


def flags(statistic: DataFrame, plans: DataFrame, level_high: float, tail: dict[str, float] | None, key: str = "chunk_id") -> DataFrame:
    """(key, pos, relative, spans, limit, drifts): paragraphs on two spans over their document's limit, unless a stronger one explains them.

    Strongest first, a paragraph that lies with both its spans around a kept one, without lying in both of that one's,
    is explained by it: a fold over a document's drifting paragraphs.
    """
    count = F.count("*").over(Window.partitionBy(key))
    bound = F.greatest(F.lit(level_high) + limit(tail, F.col("n")), F.lit(MINIMUM)) if tail else F.lit(None).cast("double")
    rows = statistic.join(plans, [key, "pos"]).withColumn("n", count).withColumn("limit", F.when(F.col("spans") == 2, bound))
    # A paragraph's inside: what both its spans hold.
    rows = rows.withColumns({"lo": F.greatest("a1", "a2"), "hi": F.least("b1", "b2"), "over": F.coalesce(F.col("relative") > F.col("limit"), F.lit(False))})
    item = F.struct((-F.col("relative")).alias("r"), "pos", "lo", "hi")
    drifting = rows.where("over").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("d"))
    none = F.array().cast("array<struct<r:double,pos:int,lo:int,hi:int>>")
    explained = lambda kept, x: F.exists(kept, lambda k: (k["pos"] >= x["lo"]) & (k["pos"] < x["hi"]) & ~((x["pos"] >= k["lo"]) & (x["pos"] < k["hi"])))
    kept = drifting.select(key, F.explode(F.aggregate("d", none, lambda a, x: F.when(explained(a, x), a).otherwise(F.concat(a, F.array(x))))).alias("k")).select(key, "k.pos", F.lit(True).alias("drifts"))
    return rows.select(key, "pos", "relative", "spans", "limit").join(kept, [key, "pos"], "left").withColumn("drifts", F.coalesce("drifts", F.lit(False)))
