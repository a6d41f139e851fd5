"""Reference statistics: floors, leave-one-document-out z-scores, reliability, Delta, contrast effects and likeness.

Long tables (chunk_id, document, grp, metric, value) throughout. What a document leaves out is the total minus its own
sums, both grouped aggregates, so nothing is recomputed for each document and no document is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.registry import METRICS

UNSEEN = 3.0
_KEY = ["grp", "metric"]


def scale_table(spark) -> DataFrame:
    """(metric, scale, share_of) of metrics that are rates or shares of a count."""
    return spark.createDataFrame([(m.metric, 1000.0 if m.unit == "/1k" else 100.0, m.share_of) for m in METRICS if m.share_of], "metric string, scale double, share_of string")


def floors(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """summary with floor, the smallest meaningful spread: half an occurrence a chunk, or 5 % of the mean.

    counts: one row, the reference's mean words, sentences and paragraphs a chunk.
    """
    units = F.when(F.col("share_of") == "words", F.col("words")).when(F.col("share_of") == "sentences", F.col("sentences")).otherwise(F.col("paragraphs"))
    got = summary.join(F.broadcast(scale_table(summary.sparkSession)), "metric", "left").crossJoin(F.broadcast(counts))  # one row
    floor = F.when(F.col("share_of").isNull(), 0.05 * F.abs("mean")).when(units > 0, F.col("scale") / 2 / units).otherwise(0.0)
    return got.withColumn("floor", floor).select(*summary.columns, "floor")


def z_score(value: Column, n: Column, mean: Column, sd: Column, floor: Column) -> Column:
    """Null under two values, 0 within a millionth, else distance over the spread; 3 in its direction without a spread."""
    gap, spread = value - mean, F.greatest(F.coalesce(sd, F.lit(0.0)), F.coalesce(floor, F.lit(0.0)))
    near = F.abs(gap) <= F.greatest(1e-6 * F.greatest(F.abs(value), F.abs(mean)), F.lit(1e-6))
    return F.when(n < 2, None).when(near, 0.0).when(spread > 0, gap / spread).otherwise(UNSEEN * F.signum(gap))


def sums(values: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """n, s1 and s2 of each metric: by document (dn, d1, d2) and over all (n, s1, s2)."""
    v = F.col(value)
    parts = values.groupBy(*_KEY, "document").agg(F.count(v).alias("dn"), F.sum(v).alias("d1"), F.sum(v * v).alias("d2"))
    return parts, parts.groupBy(*_KEY).agg(F.sum("dn").alias("n"), F.sum("d1").alias("s1"), F.sum("d2").alias("s2"))


def held_out_z(values: DataFrame, floor: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """z of each value (of `others` if given) against the chunks of other documents. floor: metric, floor."""
    parts, total = sums(values)
    rows = (values if others is None else others).join(total, _KEY).join(parts, [*_KEY, "document"], "left").join(floor.select("metric", "floor"), "metric", "left")
    zero = F.lit(0)
    rows = rows.withColumns({"n": F.col("n") - F.coalesce("dn", zero), "s1": F.col("s1") - F.coalesce("d1", zero), "s2": F.col("s2") - F.coalesce("d2", zero)})
    rows = rows.withColumn("mean", F.try_divide("s1", "n"))
    var = F.try_divide(F.col("s2") - F.col("n") * F.col("mean") * F.col("mean"), F.col("n") - 1)
    sd = F.when(var > 1e-12 * F.greatest(F.lit(1.0), F.col("mean") * F.col("mean")), F.sqrt(var)).otherwise(0.0)
    base = (values if others is None else others).columns
    return rows.withColumn("z", z_score(F.col("value"), F.col("n"), F.col("mean"), sd, F.col("floor"))).select(*base, "z").drop("value").where("z IS NOT NULL")


def z_against(values: DataFrame, stats: DataFrame) -> DataFrame:
    """z of each value against a reference's summary with floors."""
    rows = values.join(stats.select(*_KEY, "n", "mean", "sd", "floor"), _KEY)
    return rows.withColumn("z", z_score(F.col("value"), F.col("n"), F.col("mean"), F.col("sd"), F.col("floor"))).select(*[c for c in values.columns if c != "value"], "z").where("z IS NOT NULL")


def reliability(z: DataFrame) -> DataFrame:
    """(grp, metric, rms) of held-out z."""
    return z.groupBy(*_KEY).agg(F.sqrt(F.sum(F.col("z") * F.col("z")) / F.count("z")).alias("rms"))


def _areas(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """rows: keep, grp, z, rms. Weighted mean of |z| for each area."""
    w = F.when(F.col("rms").isNull(), 1.0).otherwise(1.0 / F.pow(F.greatest("rms", F.lit(1.0)), F.lit(2.0)))
    a = F.when(F.col("rms").isNull(), F.least(F.abs("z"), F.lit(UNSEEN))).otherwise(F.abs("z"))
    return rows.groupBy(*keep, "grp").agg((F.sum(w * a) / F.sum(w)).alias("delta"))


def overall(areas: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Areas, and `overall`, their plain mean."""
    return areas.unionByName(areas.groupBy(*keep).agg(F.avg("delta").alias("delta")).withColumn("grp", F.lit("overall")).select(*keep, "grp", "delta"))


def delta(z: DataFrame, rms: DataFrame, keep: tuple[str, ...] = ("chunk_id", "document")) -> DataFrame:
    """(keep, grp, delta): distance by area and overall. Metrics without a reliability weigh 1, |z| at most 3."""
    return overall(_areas(z.join(rms, _KEY, "left"), keep), keep)


def rms_without(z: DataFrame) -> DataFrame:
    """(document, grp, metric, rms): each metric's reliability without a document's own chunks, null if that leaves none."""
    parts = z.groupBy(*_KEY, "document").agg(F.count("z").alias("dn"), F.sum(F.col("z") * F.col("z")).alias("d2"))
    total = parts.groupBy(*_KEY).agg(F.sum("dn").alias("n"), F.sum("d2").alias("s2"))
    left = F.col("n") - F.col("dn")
    return parts.join(total, _KEY).select("document", *_KEY, F.when(left > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.col("d2")) / left)).alias("rms"))


def held_out_delta(z: DataFrame, keep: tuple[str, ...] = ("chunk_id", "document")) -> DataFrame:
    """delta with the reliabilities that the other documents give."""
    return overall(_areas(z.join(rms_without(z), [*_KEY, "document"], "left"), keep), keep)


def fold(reference_z: DataFrame, contrast_z: DataFrame) -> DataFrame:
    """(grp, metric, effect, rms): what tells a contrast set from the reference."""
    r = reference_z.groupBy(*_KEY).agg(F.avg("z").alias("mr"), F.sqrt(F.sum(F.col("z") * F.col("z")) / F.count("z")).alias("rms"))
    c = contrast_z.groupBy(*_KEY).agg(F.avg("z").alias("mc"))
    return r.join(c, _KEY).select(*_KEY, ((F.col("mc") - F.col("mr")) / F.greatest("rms", F.lit(1.0))).alias("effect"), "rms")


def fold_without(reference_z: DataFrame, contrast_z: DataFrame, side: str, every_metric: bool = False) -> DataFrame:
    """fold for each left-out document of a side, `reference` or `contrast`: adds document.

    For the metrics that the document has, which is what its own likeness reads; every_metric: for all, a row for each
    metric and document.
    """
    def parts(z: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = z.groupBy(*_KEY, "document").agg(F.count("z").alias("dn"), F.sum("z").alias("d1"), F.sum(F.col("z") * F.col("z")).alias("d2"))
        return own, own.groupBy(*_KEY).agg(F.sum("dn").alias("n"), F.sum("d1").alias("s1"), F.sum("d2").alias("s2"))

    (rp, rt), (cp, ct) = parts(reference_z), parts(contrast_z)
    ct = ct.select(*_KEY, F.col("n").alias("cn"), F.col("s1").alias("c1"))
    own = (rp if side == "reference" else cp).select(*_KEY, "document", "dn", "d1", "d2")
    got = rt.join(ct, _KEY)
    if every_metric:  # the size of the result
        got = got.crossJoin(own.select("document").distinct()).join(own, [*_KEY, "document"], "left").fillna(0, ["dn", "d1", "d2"])
    else:
        got = got.join(own, _KEY)
    if side == "reference":
        got = got.withColumns({"n": F.col("n") - F.col("dn"), "s1": F.col("s1") - F.col("d1"), "s2": F.greatest(F.lit(0.0), F.col("s2") - F.col("d2"))})
    else:
        got = got.withColumns({"cn": F.col("cn") - F.col("dn"), "c1": F.col("c1") - F.col("d1")})
    got = got.where("n > 0 AND cn > 0").withColumn("rms", F.sqrt(F.col("s2") / F.col("n")))
    return got.select("document", *_KEY, ((F.col("c1") / F.col("cn") - F.col("s1") / F.col("n")) / F.greatest("rms", F.lit(1.0))).alias("effect"), "rms")


def _liked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"w": F.col("effect") * F.col("effect"), "part": F.col("effect") * F.col("effect") * F.greatest(F.lit(0.0), F.signum("effect") * F.col("z")) / F.greatest("rms", F.lit(1.0))})


def likeness(z: DataFrame, effects: DataFrame, keep: tuple[str, ...] = ("chunk_id", "document")) -> DataFrame:
    """(keep, likeness): how far the differences that the contrast set has appear here too. effects may be by document."""
    on = [*_KEY, "document"] if "document" in effects.columns else _KEY
    return _liked(z.join(effects, on)).groupBy(*keep).agg(F.try_divide(F.sum("part"), F.sum("w")).alias("likeness"))


def signals(z: DataFrame, effects: DataFrame, k: int = 5) -> DataFrame:
    """(chunk_id, grp, metric, z, share, rank): the metrics that make most of a chunk's likeness."""
    every = Window.partitionBy("chunk_id")
    rows = _liked(z.join(effects, _KEY)).withColumn("share", F.try_divide("part", F.sum("w").over(every))).where("part > 0")
    rank = F.row_number().over(every.orderBy(F.desc("share"), F.desc("grp"), F.desc("metric"), F.desc("z")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("chunk_id", *_KEY, "z", "share", "rank")


def deviations(z: DataFrame, k: int = 8) -> DataFrame:
    """(chunk_id, grp, metric, z, rank): a chunk's largest differences, ties by metric."""
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(F.abs("z")), "grp", "metric"))
    return z.withColumn("rank", rank).where(F.col("rank") <= k).select("chunk_id", *_KEY, "z", "rank")


def capped(z: DataFrame, areas: Sequence[str] = ("syntax", "sentence_openers"), cap: float = UNSEEN) -> DataFrame:
    """z with those of some areas limited either way: short spans swing there."""
    return z.withColumn("z", F.when(F.col("grp").isin(*areas), F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("z")))).otherwise(F.col("z")))


def average_z(z: DataFrame, values: DataFrame, summary: DataFrame, keep: Sequence[str] = ("document",)) -> DataFrame:
    """(keep, grp, metric, z): the mean z of chunks. z may have `scale`, how much more the metric swings at a chunk's length.

    A metric that the reference never varies on scores the same size each way: its mean size, signed by the side that the
    mean value lies on, so opposite differences can't cancel.
    """
    own = F.col("z") / (F.col("scale") if "scale" in z.columns else F.lit(1.0))
    means = z.groupBy(*keep, *_KEY).agg(F.avg(own).alias("plain"), F.avg(F.abs(own)).alias("size"))
    here = values.groupBy(*keep, *_KEY).agg(F.avg("value").alias("here"))
    rows = means.join(here, [*keep, *_KEY], "left").join(summary.select(*_KEY, "sd", "mean"), _KEY, "left")
    signed = F.when(F.coalesce("here", F.lit(0.0)) < F.coalesce("mean", F.lit(0.0)), -F.col("size")).otherwise(F.col("size"))
    return rows.select(*keep, *_KEY, F.when(F.coalesce("sd", F.lit(0.0)) != 0, F.col("plain")).otherwise(signed).alias("z"))
