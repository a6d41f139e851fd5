"""Length-aware ranges and verdicts: anchors by length, interpolation, pooled ceilings, levels, flags, the gate.

An anchor is a row (area, words, covers, median, mean, p95, similarity): the range that the reference's own texts of about
so many words fall in. There are a few rows an area, so they are broadcast; chunks stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import stats

LEAST_WORDS = 75
LEAST_DOCUMENTS, LEAST_PIECES = 3, 20
DELTA_FLOOR, LIKENESS_FLOOR = 0.5, 0.25
VERDICTS = ("close", "somewhat different", "clearly different", "very different")
TOO_SHORT = "too short to judge"
RANGE = ("median", "mean", "p95", "similarity")


def single_pieces(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """texts that are whole pieces of a length (that to one and a half times that many words), with length."""
    own = F.filter(F.array(*map(F.lit, lengths)), lambda n: (F.col("words") >= n) & (F.col("words") * 2 < n * 3))
    return texts.select("*", F.explode(own).alias("length"))


def _cuts(sizes: list[int], blocks: list[int], length: int, inside: float) -> list[int]:
    starts = np.r_[0, np.cumsum(sizes)].astype(float)
    count = round(starts[-1] / length)
    if count < 2 or 2 * starts[-1] < 3 * length:
        return []
    extra = np.r_[0.0, np.where(np.diff(blocks) == 0, inside, 0.0)]
    cuts = [0]
    for part in range(1, count):
        free = np.arange(cuts[-1] + 1, len(sizes))
        if not len(free):
            break
        cuts.append(int(free[np.argmin(np.abs(starts[free] - part * starts[-1] / count) + extra[free])]))
    return cuts


def cut_points(units: Column, length: int, excerpts: bool = False) -> Column:
    """Where units (array of struct(n, block)) start pieces of about `length` words; empty under one and a half pieces.

    round(words / length) pieces of equal share, each cut at the nearest unit; unless `excerpts`, a cut inside a block
    counts a quarter of a piece further.
    """

    @F.arrow_udf("array<int>")
    def cut(column: pa.Array) -> pa.Array:
        rows = [x or [] for x in column.to_pylist()]
        return pa.array([_cuts([u["n"] for u in r], [u["block"] for u in r], length, 0.0 if excerpts else 0.25 * length) if r else [] for r in rows], pa.list_(pa.int32()))

    return cut.asNondeterministic()(units)  # so that no generator takes it in


def _whole(sizes: list[int], length: int) -> list[tuple[int, int, bool]]:
    """Runs (first, end, to cut) of whole texts that are pieces."""
    out, start, count = [], 0, 0
    for i, n in enumerate([*sizes, None]):
        if n is None or n >= length or (i > start and count + n > length):
            if i > start and 2 * count >= length:
                out.append((start, i, False))
            start, count = i, 0
        if n is not None and n >= length:
            out.append((i, i + 1, 2 * n >= 3 * length))
            start = i + 1
        elif n is not None:
            count += n
    return out


def whole_parts(sizes: Column, length: int) -> Column:
    """Pieces of a pooled window along the texts it was joined from, of their sizes in order: array of struct(first, last, cut), ends exclusive.

    A piece is a run of whole texts of up to `length` words, or one longer text, which is cut by cut_points at one and a
    half pieces. A run under half a piece is none.
    """

    @F.arrow_udf("array<struct<first:int,last:int,cut:boolean>>")
    def whole(column: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("first", "last", "cut"), p)) for p in _whole(x or [], length)] for x in column.to_pylist()], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cut", pa.bool_())])))

    return whole(sizes)


def by_length(pieces: DataFrame) -> DataFrame:
    """pieces: length, area (with `overall`), document, words, value. Rows (length, area, pieces, documents, words, effective, enough, RANGE).

    All lengths share one intraclass correlation, the mean of theirs weighted by pieces, with a floor for few documents.
    """
    g = stats.by_document(pieces, ("length", "area"))
    over = g.where("area = 'overall'")
    known = F.col("icc").isNotNull()
    shared = over.agg(F.coalesce(F.try_divide(F.sum(F.when(known, F.col("icc") * F.col("count"))), F.sum(F.when(known, F.col("count")))), F.lit(0.0)).alias("shared"))
    docs = pieces.where("area = 'overall'").agg(F.countDistinct("document").alias("all"))
    floor = F.when(F.col("all") < stats.FLOOR_DOCUMENTS, F.greatest("shared", F.lit(stats.SIMILARITY_FLOOR))).otherwise(F.col("shared"))
    one = shared.crossJoin(docs).select(floor.alias("icc"))  # one row
    effective = F.when(F.col("documents") < 2, F.least("count", F.lit(1)).cast("double")).otherwise(F.col("count") / (1 + (F.col("n0") - 1) * F.col("icc")))
    rows = g.drop("icc", "effective").crossJoin(F.broadcast(one)).withColumn("effective", effective)
    size = pieces.where("area = 'overall'").groupBy("length").agg(F.median("words").alias("words"))
    enough = rows.where("area = 'overall'").select("length", ((F.col("documents") >= LEAST_DOCUMENTS) & (F.col("effective") >= LEAST_PIECES)).alias("enough"))
    bound = pieces.join(rows.select("length", "area", stats.upper_share(0.95, F.col("effective")).alias("bound")), ["length", "area"])
    p95 = stats.nearest_rank(bound, ("length", "area", "bound"), {"p95": F.col("bound")}).drop("bound")
    middle = pieces.groupBy("length", "area").agg(F.median("value").alias("median"))
    out = rows.join(size, "length").join(enough, "length").join(p95, ["length", "area"]).join(middle, ["length", "area"])
    return out.select("length", "area", F.col("count").alias("pieces"), "documents", "words", "effective", "enough", "median", stats.upper_mean(rows).alias("mean"), "p95", F.greatest("icc", F.lit(stats.LEAST_RUN_SIMILARITY)).alias("similarity"))


def anchors(lengths: DataFrame, window: DataFrame) -> DataFrame:
    """lengths: by_length's rows; window: area, words and RANGE of whole windows. The lengths that are enough and shorter than windows, and windows."""
    whole = window.select("area", "words", (F.col("words") / 2).alias("covers"), *RANGE)
    short = lengths.where("enough").join(F.broadcast(window.select("area", F.col("words").alias("w"))), "area").where("words > 0 AND words < w")
    return whole.unionByName(short.select("area", "words", F.col("length").cast("double").alias("covers"), *RANGE))


def at_words(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """chunks (with words) and a row for each area with RANGE at that many words: linear in the logarithm between anchors.

    Outside it is the nearest anchor's, and below the shortest the spread widens with the root of anchor over words.
    """
    run = Window.partitionBy("area").orderBy("words")
    edged = points.withColumns({"low": F.lag("words").over(run), "first": F.row_number().over(run) == 1, "last": F.lead("words").over(run).isNull(), **{f"l_{c}": F.lag(c).over(run) for c in RANGE}})
    # One row for each gap, with the anchor above it, and one above the last anchor.
    ends = edged.select("area", F.col("low").alias("lo"), F.col("words").alias("hi"), "first", F.col("words").alias("at"), *[F.struct(F.col(f"l_{c}").alias("a"), F.col(c).alias("b")).alias(c) for c in RANGE])
    above = edged.where("last").select("area", F.col("words").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("first"), F.col("words").alias("at"), *[F.struct(F.col(c).alias("a"), F.lit(None).cast("double").alias("b")).alias(c) for c in RANGE])
    gaps = F.broadcast(ends.unionByName(above))
    w = F.col("words")
    rows = chunks.join(gaps, (F.col("lo").isNull() | (w > F.col("lo"))) & (F.col("hi").isNull() | (w <= F.col("hi"))))
    share = F.log(w / F.col("lo")) / F.log(F.col("hi") / F.col("lo"))
    value = lambda c: F.when(F.col("first"), F.col(c)["b"]).when(F.col("hi").isNull(), F.col(c)["a"]).otherwise(F.col(c)["a"] + share * (F.col(c)["b"] - F.col(c)["a"]))
    widen = F.when(F.col("first") & (w > 0) & (w < F.col("at")), F.sqrt(F.col("at") / w)).otherwise(1.0)
    return rows.select(*chunks.columns, "area", *[(value(c) * (F.lit(1.0) if c == "similarity" else widen)).alias(c) for c in RANGE])


def judged(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """chunks with judged: long enough, and covered by an anchor."""
    least = points.where("area = 'overall'").agg(F.min("covers").alias("least"))
    return chunks.crossJoin(F.broadcast(least)).withColumn("judged", (F.col("words") >= LEAST_WORDS) & F.coalesce(F.col("least") <= F.col("words"), F.lit(False))).drop("least")  # one row


def pooled_ceiling(floor: float) -> Column:
    """Upper bound of the mean of a group's values, each with its RANGE; an ordinary aggregate."""
    s = F.greatest(F.col("p95") - F.col("mean"), F.lit(0.0))
    spread = F.sqrt(F.sum((1 - F.col("similarity")) * s * s) + F.pow(F.sum(F.sqrt("similarity") * s), F.lit(2.0)))
    many = F.avg("mean") + spread / F.count("mean")
    return F.greatest(F.when(F.count("mean") == 1, F.max("p95")).otherwise(many), F.lit(floor))


def mean_ceiling(mean: Column, p95: Column, similarity: Column, count: Column, floor: float) -> Column:
    """pooled_ceiling of `count` equal ranges."""
    n, s = F.greatest(count, F.lit(1)), F.greatest(p95 - mean, F.lit(0.0))
    return F.greatest(F.when(n == 1, p95).otherwise(mean + s * F.sqrt(similarity + (1 - similarity) / n)), F.lit(floor))


def delta_level(delta: Column, ceiling: Column) -> Column:
    """0 to 3 by one, one and a half and two ceilings; fixed steps without a ceiling."""
    fixed = F.when(delta < 1.0, 0).when(delta < 1.5, 1).when(delta < 2.5, 2).otherwise(3)
    known = F.when(delta <= ceiling, 0).when(delta <= 1.5 * ceiling, 1).when(delta <= 2 * ceiling, 2).otherwise(3)
    return F.when(delta.isNull(), None).when(F.coalesce(ceiling, F.lit(0.0)) > 0, known).otherwise(fixed)


def likeness_level(score: Column, ceiling: Column, target: Column) -> Column:
    """0 to 3 from the top of the reference's range to the contrast set's usual score."""
    step = F.when(score <= ceiling, 0).when(target <= ceiling, 1).when(score < (ceiling + target) / 2, 1).when(score < target, 2).otherwise(3)
    return F.when(score.isNotNull() & ceiling.isNotNull() & target.isNotNull(), step)


def verdict(level: Column, is_judged: Column) -> Column:
    words = F.element_at(F.array(*map(F.lit, VERDICTS)), level + 1)
    return F.when(~is_judged, TOO_SHORT).when(level.isNull(), "not comparable").otherwise(words)


def chunk_levels(chunks: DataFrame) -> DataFrame:
    """chunks: judged, delta, delta range (p95), likeness, its range (l_p95) and target. Adds level, likeness_level, flagged."""
    level = F.when(F.col("judged"), delta_level(F.col("delta"), F.greatest("p95", F.lit(DELTA_FLOOR))))
    liked = F.when(F.col("judged"), likeness_level(F.col("likeness"), F.greatest("l_p95", F.lit(LIKENESS_FLOOR)), F.col("target")))
    got = chunks.withColumns({"level": level, "likeness_level": liked})
    return got.withColumn("flagged", F.coalesce(F.col("judged") & ((F.col("level") >= 2) | (F.coalesce("likeness_level", F.lit(0)) >= 2)), F.lit(False)))
