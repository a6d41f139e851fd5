"""Does likeness survive editing: survival of the strongest effects, set summaries, retraining with lineages held out, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions.tokens import WORD
from inkwell.operators import reference as ref

LEAST_GAP = 0.05


def edit_statistics(pairs: DataFrame, changed: DataFrame, old: str = "old", new: str = "new", key: str = "pair") -> DataFrame:
    """One row: pairs, median and mean share of changed sequences, median and mean word ratio. changed: key, changed."""
    n = lambda c: F.regexp_count(F.col(c), F.lit(WORD))
    rows = pairs.select(key, F.try_divide(n(new), n(old)).alias("ratio")).join(changed.select(key, "changed"), key, "left")
    return rows.agg(F.count("*").alias("pairs"), F.median("changed").alias("changed_median"), F.avg("changed").alias("changed_mean"), F.median("ratio").alias("ratio_median"), F.avg("ratio").alias("ratio_mean"))


def signal_survival(effects: DataFrame, reference_z: DataFrame, original_z: DataFrame, edited_z: DataFrame, k: int = 10) -> DataFrame:
    """(grp, metric, effect, remaining) of the strongest effects: how much of the gap to the reference edits leave."""
    top = effects.orderBy(F.desc(F.abs("effect")), "grp", "metric").limit(k)
    mean = lambda z, name: z.groupBy("grp", "metric").agg(F.avg("z").alias(name))
    rows = top.join(mean(reference_z, "r"), ["grp", "metric"]).join(mean(original_z, "o"), ["grp", "metric"]).join(mean(edited_z, "e"), ["grp", "metric"], "left")
    gap = F.col("o") - F.col("r")
    return rows.select("grp", "metric", "effect", F.when(F.abs(gap) >= LEAST_GAP, (F.col("e") - F.col("r")) / gap).alias("remaining"))


def level_histogram(levels: DataFrame, level: str = "level") -> DataFrame:
    """(level, texts): a row for each of the four levels, zeros included."""
    every = levels.sparkSession.range(4).select(F.col("id").cast("int").alias("level"))
    return every.join(levels.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("texts")), "level", "left").fillna(0, ["texts"])


def retrained(reference_z: DataFrame, contrast_z: DataFrame, edited_z: DataFrame) -> DataFrame:
    """(auc): cross-validated, the contrast set widened by edits; document is the lineage, held out with all its edits."""
    both = contrast_z.unionByName(edited_z)
    a = ref.likeness(reference_z, ref.fold_without(reference_z, both, "reference")).select(F.col("likeness").alias("score"), F.lit(False).alias("positive"))
    b = ref.likeness(both, ref.fold_without(reference_z, both, "contrast")).select(F.col("likeness").alias("score"), F.lit(True).alias("positive"))
    return stats.auc(a.unionByName(b))


def bootstrap_auc(scores: DataFrame, resamples: int = 200, seed: int = 1) -> DataFrame:
    """scores: score, positive, document. (resample, auc): documents of both sides drawn with replacement.

    A draw is a hash of seed, resample, side and number, so reruns agree and no stream is shared. A document drawn k times
    weighs k; the chance of a win is a weighted prefix sum over ordered scores, by resample.
    """
    docs = scores.where("score IS NOT NULL").select("positive", "document").distinct()
    place = docs.withColumn("at", F.row_number().over(Window.partitionBy("positive").orderBy("document")) - 1)
    n = docs.groupBy("positive").agg(F.count("*").alias("n"))
    drawn = n.select("positive", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample")).select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    drawn = drawn.select("positive", "resample", F.pmod(F.xxhash64(F.lit(seed), "resample", "positive", "i"), F.col("n")).alias("at")).groupBy("positive", "resample", "at").agg(F.count("*").alias("w"))
    rows = scores.where("score IS NOT NULL").join(drawn.join(place, ["positive", "at"]), ["positive", "document"])
    each = rows.groupBy("resample", "score").agg(F.sum(F.when(F.col("positive"), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("w"))).alias("q"))
    run = Window.partitionBy("resample").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = each.withColumn("under", F.coalesce(F.sum("q").over(run), F.lit(0)))
    return wins.groupBy("resample").agg(F.try_divide(F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def interval(resamples: DataFrame, share: float = 0.95) -> DataFrame:
    """One row (low, high): nearest ranks of resampled values."""
    tail = (1 - share) / 2
    return stats.nearest_rank(resamples.withColumnRenamed("auc", "value"), (), {"low": F.lit(tail), "high": F.lit(1 - tail)})


def fold_scores(reference_z: DataFrame, contrast_z: DataFrame, edited_z: DataFrame) -> DataFrame:
    """(chunk_id, document, likeness) of edited chunks, under the fold learned without their original; document is the original's.

    A chunk whose document has no fold has a null likeness, never one from a fold that saw it.
    """
    scored = ref.likeness(edited_z, ref.fold_without(reference_z, contrast_z, "contrast", every_metric=True))
    return edited_z.select("chunk_id", "document").distinct().join(scored, ["chunk_id", "document"], "left")


def auc_confidence(scores: DataFrame, resamples: int = 200, seed: int = 1, share: float = 0.95) -> DataFrame:
    """scores: score, positive, document. One row (auc, low, high, method, resamples, reference_documents, contrast_documents).

    method is exact where no resample can differ (the sides don't overlap, or there is one score), bootstrap, or null with
    no interval where a side has under two documents.
    """
    rows = scores.where("score IS NOT NULL")
    side = lambda f, p: f(F.when(F.col("positive") == F.lit(p), F.col("score")))
    told = rows.agg(
        F.count_distinct(F.when(~F.col("positive"), F.col("document"))).alias("reference_documents"), F.count_distinct(F.when(F.col("positive"), F.col("document"))).alias("contrast_documents"),
        side(F.min, True).alias("pl"), side(F.max, True).alias("ph"), side(F.min, False).alias("nl"), side(F.max, False).alias("nh"),
    )
    fixed = (F.col("pl") > F.col("nh")) | (F.col("ph") < F.col("nl")) | ((F.col("pl") == F.col("nh")) & (F.col("ph") == F.col("nl")))
    method = F.when((F.col("reference_documents") >= 2) & (F.col("contrast_documents") >= 2), F.when(fixed, "exact").otherwise("bootstrap"))
    own = stats.auc(rows)
    drawn = interval(bootstrap_auc(rows, resamples, seed), share)
    got = told.withColumn("method", method).crossJoin(own).join(drawn, F.lit(True), "left")  # one row each
    bound = lambda c: F.when(F.col("method") == "exact", F.col("auc")).when(F.col("method") == "bootstrap", F.col(c)).alias(c)
    return got.select("auc", bound("low"), bound("high"), "method", F.when(F.col("method") == "bootstrap", resamples).otherwise(0).alias("resamples"), "reference_documents", "contrast_documents")
