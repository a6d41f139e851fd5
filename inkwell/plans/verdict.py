"""Queries over length-aware ranges and verdicts. Drafts are judged chunk by chunk, and by document (their source)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.operators import ranges, reference as ref
from inkwell.operators.corpus import LENGTHS
from inkwell.plans.base import ROLES
from inkwell.sources.scratch import materialize
from inkwell.plans.reference import SQL_RANGE, SQL_SETUP, Setup, _loo, _query, _r, _t, delta_range_table


class Judge(Setup):
    """Adds anchors, and drafts with their distance, likeness and ranges."""

    @cached_property
    def every_words(self) -> DataFrame:
        return self.words.select("chunk_id", F.col("words").cast("double").alias("words"))

    @cached_property
    def held(self) -> DataFrame:
        return ref.held_out_delta(self.z).join(self.every_words, "chunk_id").select("chunk_id", F.col("grp").alias("area"), "document", "words", F.col("delta").alias("value")).transform(materialize)

    @cached_property
    def pieces(self) -> DataFrame:
        return ranges.single_pieces(self.held, LENGTHS)

    @cached_property
    def window(self) -> DataFrame:
        size = self.held.where("area = 'overall'").agg(F.median("words").alias("words"))
        return delta_range_table(self.held.drop("words", "chunk_id")).crossJoin(F.broadcast(size)).select("area", "words", *ranges.RANGE).transform(materialize)  # one row

    @cached_property
    def points(self) -> DataFrame:
        return materialize(ranges.anchors(ranges.by_length(self.pieces), self.window))

    @cached_property
    def draft_words(self) -> DataFrame:
        return self.every_words.join(self.words.where("role = 'draft'").select("chunk_id"), "chunk_id")

    @cached_property
    def deltas(self) -> DataFrame:
        return ref.delta(self.draft_z, self.rms)

    def ranged(self) -> DataFrame:
        """(chunk_id, document, words, judged, area, delta, RANGE) of drafts."""
        rows = ranges.judged(ranges.at_words(self.draft_words, self.points), self.points)
        return rows.join(self.deltas.withColumnRenamed("grp", "area"), ["chunk_id", "area"])

    def likeness_range(self) -> DataFrame:
        """One row: RANGE of the writers' likeness, and target, the contrast chunks' median."""
        both = _loo(self)
        own = both.where("side = 'writer'").select(F.lit("likeness").alias("area"), "document", F.col("likeness").alias("value"))
        target = both.where("side = 'contrast'").agg(F.median("likeness").alias("target"))
        return delta_range_table(own).select(*[F.col(c).alias(f"l_{c}") for c in ranges.RANGE]).crossJoin(target).transform(materialize)  # one row

    def chunks(self) -> DataFrame:
        """Drafts with distance and likeness, their ranges, levels and flag."""
        liked = ref.likeness(self.draft_z, ref.fold(self.z, self.contrast_z))
        rows = self.ranged().where("area = 'overall'").join(liked.drop("document"), "chunk_id", "left")
        own = self.window.where("area = 'overall'").select(F.col("words").alias("w"))
        rows = rows.crossJoin(F.broadcast(self.likeness_range())).crossJoin(F.broadcast(own))  # one row each
        widen = F.when(F.col("words") < F.col("w"), F.sqrt(F.col("w") / F.col("words"))).otherwise(1.0)
        rows = rows.withColumns({c: F.col(c) * widen for c in ("l_median", "l_mean", "l_p95")}).drop("w", "area")
        return materialize(ranges.chunk_levels(rows))


def _judged(*roles: str):
    return _query(*roles, setup=Judge)


@_judged("writer")
def length_anchors(s: Judge) -> DataFrame:
    """Ranges of the writers' own texts by length and area, and how many pieces they rest on."""
    return ranges.by_length(s.pieces)


@_judged("writer", "draft")
def interpolated_ranges(s: Judge) -> DataFrame:
    """The range of each area at each draft's length."""
    return s.ranged().drop("delta", "document")


@_judged(*ROLES)
def verdict_chunks(s: Judge) -> DataFrame:
    """Each draft's distance, level and verdict."""
    return s.chunks().select("chunk_id", "document", F.col("words").cast("int").alias("words"), "delta", "level", ranges.verdict(F.col("level"), F.col("judged")).alias("verdict"))


@_judged(*ROLES)
def flagged_chunks(s: Judge) -> DataFrame:
    """Drafts that read clearly different on their own, or lean to the contrast set."""
    return s.chunks().where("flagged").select("chunk_id", "delta", "level", "likeness", "likeness_level")


@_judged("writer", "draft")
def pooled_ceiling(s: Judge) -> DataFrame:
    """By document and area: mean distance of its judged drafts, the bound of such a mean, and the level."""
    rows = s.ranged().where("judged").groupBy("document", "area").agg(F.count("*").alias("chunks"), F.avg("delta").alias("delta"), ranges.pooled_ceiling(ranges.DELTA_FLOOR).alias("ceiling"))
    return rows.withColumn("level", ranges.delta_level(F.col("delta"), F.col("ceiling")))


def documents(s: Judge) -> DataFrame:
    rows = s.chunks()
    every = rows.groupBy("document").agg(F.count("*").alias("chunks"), F.sum("words").cast("long").alias("words"), F.count_if("judged").alias("chunks_judged"), F.count_if("flagged").alias("flagged"))
    good = rows.where("judged")
    delta = good.groupBy("document").agg(F.avg("delta").alias("delta"), ranges.pooled_ceiling(ranges.DELTA_FLOOR).alias("ceiling"))
    liked = good.where("likeness IS NOT NULL").select("document", "likeness", "target", *[F.col(f"l_{c}").alias(c) for c in ranges.RANGE])
    liked = liked.groupBy("document").agg(F.avg("likeness").alias("likeness"), ranges.pooled_ceiling(ranges.LIKENESS_FLOOR).alias("lc"), F.avg("target").alias("target"))
    out = every.join(delta, "document", "left").join(liked, "document", "left").withColumn("level", ranges.delta_level(F.col("delta"), F.col("ceiling")))
    return out.select("document", "chunks", "chunks_judged", "words", "delta", "ceiling", "level", ranges.verdict(F.col("level"), F.col("chunks_judged") > 0).alias("verdict"), "likeness", ranges.likeness_level(F.col("likeness"), F.col("lc"), F.col("target")).alias("likeness_level"), "flagged")


@_judged(*ROLES)
def verdict_documents(s: Judge) -> DataFrame:
    """The verdict on each document of drafts, its chunks pooled."""
    return documents(s)


@_judged(*ROLES)
def fail_gate(s: Judge) -> DataFrame:
    """Documents that a gate at `somewhat different`, `leans` or 3 flagged chunks turns down, and why."""
    failed = F.array_compact(F.array(F.when(F.col("level") >= 1, "distance"), F.when(F.col("likeness_level") >= 2, "likeness"), F.when(F.col("flagged") >= 3, "flagged")))
    return documents(s).select("document", F.array_join(failed, ",").alias("failed")).where("failed <> ''")


def _anova(name: str, source: str, by: str, value: str) -> str:
    return f"""{name}_d AS (SELECT {by}, document, count(*) AS c, avg({value}) AS m, var_pop({value}) AS w FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
{name}_a AS (SELECT {by}, sum(c) AS count, count(*) AS documents, sum(c * m) / sum(c) AS mean, sum(c * c) AS squares, sum(c * w) AS within, greatest(sum(c * m * m) - sum(c * m) ^ 2 / sum(c), 0) AS between FROM {name}_d GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN documents >= 2 AND count > documents THEN CASE WHEN mb + (n0 - 1) * mw > 0 THEN least(greatest((mb - mw) / (mb + (n0 - 1) * mw), 0), 1) ELSE 0 END END AS icc, sqrt((within + between) / nullif(count - 1, 0)) AS sd
  FROM (SELECT *, CASE WHEN documents < 2 THEN count ELSE (count - squares / count) / (documents - 1) END AS n0, between / nullif(documents - 1, 0) AS mb, within / nullif(count - documents, 0) AS mw FROM {name}_a))"""


_bound = f"d[CAST(round_even(least(0.95::DOUBLE + {stats.UPPER_Z} * sqrt(0.95::DOUBLE * (1 - 0.95::DOUBLE) / greatest(effective, 1)), 1) * (len(d) - 1), 0) AS BIGINT) + 1]"
_up = f"CASE WHEN count < 2 THEN mean ELSE mean + ({_t}) * sd / sqrt(greatest(effective, 1)) END"
_pool = "greatest(CASE WHEN count(*) = 1 THEN max(p95) ELSE avg(mean) + sqrt(sum((1 - similarity) * greatest(p95 - mean, 0) ^ 2) + sum(sqrt(similarity) * greatest(p95 - mean, 0)) ^ 2) / count(*) END, {})"
_level = "CASE WHEN {d} IS NULL THEN NULL WHEN {d} <= {c} THEN 0 WHEN {d} <= 1.5 * {c} THEN 1 WHEN {d} <= 2 * {c} THEN 2 ELSE 3 END"
_lean = "CASE WHEN {s} IS NULL OR {c} IS NULL OR {t} IS NULL THEN NULL WHEN {s} <= {c} THEN 0 WHEN {t} <= {c} THEN 1 WHEN {s} < ({c} + {t}) / 2 THEN 1 WHEN {s} < {t} THEN 2 ELSE 3 END"
_say = "CASE WHEN NOT {j} THEN 'too short to judge' WHEN level IS NULL THEN 'not comparable' ELSE ['close', 'somewhat different', 'clearly different', 'very different'][level + 1] END"
SQL_POINTS = f"""{SQL_SETUP}, {SQL_RANGE},
hw AS (SELECT grp AS area, document, chunk_id, delta AS value, CAST(n AS DOUBLE) AS words FROM hd JOIN words USING (chunk_id)),
pc AS (SELECT length, hw.* FROM hw, (VALUES (75), (150), (300)) b(length) WHERE words >= length AND words * 2 < length * 3),
{_anova('pg', 'pc', 'length, area', 'value')},
shared AS (SELECT CASE WHEN (SELECT count(DISTINCT document) FROM pc) < 10 THEN greatest(i, 0.2) ELSE i END AS shared FROM (SELECT coalesce(sum(icc * count) / sum(count) FILTER (icc IS NOT NULL), 0) AS i FROM pg WHERE area = 'overall')),
pe AS (SELECT pg.* EXCLUDE (icc), shared AS icc, CASE WHEN documents < 2 THEN least(count, 1) ELSE count / (1 + (n0 - 1) * shared) END AS effective FROM pg, shared),
bl AS (SELECT length, area, CAST(count AS BIGINT) AS pieces, documents, s.words, effective, e.enough, l.median, {_up} AS mean, {_bound} AS p95, greatest(icc, 0.05) AS similarity
       FROM pe JOIN (SELECT length, median(words) AS words FROM pc WHERE area = 'overall' GROUP BY 1) s USING (length) JOIN (SELECT length, documents >= 3 AND effective >= 20 AS enough FROM pe WHERE area = 'overall') e USING (length)
       JOIN (SELECT length, area, list(value ORDER BY value) AS d, median(value) AS median FROM pc GROUP BY ALL) l USING (length, area)),
win AS (SELECT area, (SELECT median(words) FROM hw WHERE area = 'overall') AS words, median, mean, p95, similarity FROM range_),
pts AS (SELECT area, words, words / 2 AS covers, median, mean, p95, similarity FROM win UNION ALL SELECT b.area, b.words, length, b.median, b.mean, b.p95, b.similarity FROM bl b JOIN win w USING (area) WHERE enough AND b.words > 0 AND b.words < w.words),
dw AS (SELECT chunk_id, document, CAST(n AS DOUBLE) AS words FROM base JOIN words USING (chunk_id) WHERE role = 'draft' AND n > 0),
lo AS (SELECT chunk_id, area, arg_max(p, p.words) AS a FROM dw JOIN pts p ON p.words < dw.words GROUP BY ALL), hi AS (SELECT chunk_id, area, arg_min(p, p.words) AS b FROM dw JOIN pts p ON p.words >= dw.words GROUP BY ALL),
rg AS (SELECT chunk_id, area, words, words >= 75 AND (SELECT min(covers) FROM pts WHERE area = 'overall') <= words AS judged, {', '.join(f"(CASE WHEN a IS NULL THEN b.{c} WHEN b IS NULL THEN a.{c} ELSE a.{c} + ln(words / a.words) / ln(b.words / a.words) * (b.{c} - a.{c}) END) * " + ('1' if c == 'similarity' else 'CASE WHEN a IS NULL AND words < b.words THEN sqrt(b.words / words) ELSE 1 END') + f" AS {c}" for c in ranges.RANGE)}
       FROM (SELECT chunk_id, area, lo.a, hi.b FROM lo FULL JOIN hi USING (chunk_id, area)) JOIN dw USING (chunk_id)),
da AS (SELECT chunk_id, document, grp, sum(abs(z) / greatest(rms, 1) ^ 2) / sum(1 / greatest(rms, 1) ^ 2) AS delta FROM dz JOIN rms USING (grp, metric) GROUP BY ALL),
dd AS (SELECT * FROM da UNION ALL SELECT chunk_id, document, 'overall', avg(delta) FROM da GROUP BY ALL),
rd AS (SELECT rg.*, document, delta FROM rg JOIN dd ON dd.chunk_id = rg.chunk_id AND dd.grp = area),
lw AS (SELECT 1 AS one, document, likeness FROM liked WHERE side = 'writer'),
{_anova('lg', 'lw', 'one', 'likeness')},
lr AS (SELECT {_up} AS l_mean, greatest(CASE WHEN documents < 10 THEN greatest(coalesce(icc, 0), 0.2) ELSE coalesce(icc, 0) END, 0.05) AS l_similarity, d[CAST(round_even(0.95::DOUBLE * (len(d) - 1), 0) AS BIGINT) + 1] AS l_p95, (SELECT median(likeness) FROM liked WHERE side = 'contrast') AS target
       FROM (SELECT *, CASE WHEN documents < 2 THEN least(count, 1) ELSE count / (1 + (n0 - 1) * coalesce(icc, 0)) END AS effective FROM lg), (SELECT list(likeness ORDER BY likeness) AS d FROM lw WHERE likeness IS NOT NULL)),
dl AS (SELECT chunk_id, sum(effect * effect * greatest(0, sign(effect) * z) / greatest(rms, 1)) / nullif(sum(effect * effect), 0) AS likeness FROM dz JOIN fold USING (grp, metric) GROUP BY ALL),
ck AS (SELECT *, judged AND (level >= 2 OR coalesce(likeness_level, 0) >= 2) AS flagged FROM (
  SELECT *, CASE WHEN judged THEN {_level.format(d='delta', c='greatest(p95, 0.5)')} END AS level, CASE WHEN judged THEN {_lean.format(s='likeness', c='greatest(l_p95, 0.25)', t='target')} END AS likeness_level
  FROM (SELECT rd.*, likeness, l_mean * f AS l_mean, l_p95 * f AS l_p95, l_similarity, target FROM rd LEFT JOIN dl USING (chunk_id), lr, LATERAL (SELECT CASE WHEN rd.words < w.words THEN sqrt(w.words / rd.words) ELSE 1 END AS f FROM win w WHERE area = 'overall') WHERE rd.area = 'overall'))),
dc AS (SELECT document, chunks, chunks_judged, words, delta, ceiling, {_level.format(d='delta', c='ceiling')} AS level, likeness, {_lean.format(s='likeness', c='lc', t='target')} AS likeness_level, flagged FROM
  (SELECT document, count(*) AS chunks, count(*) FILTER (judged) AS chunks_judged, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (flagged) AS flagged FROM ck GROUP BY 1)
  LEFT JOIN (SELECT document, avg(delta) AS delta, {_pool.format(0.5)} AS ceiling FROM ck WHERE judged GROUP BY 1) USING (document)
  LEFT JOIN (SELECT document, avg(likeness) AS likeness, {_pool.format(0.25)} AS lc, avg(target) AS target FROM (SELECT document, likeness, target, l_mean AS mean, l_p95 AS p95, l_similarity AS similarity FROM ck WHERE judged AND likeness IS NOT NULL) GROUP BY 1) USING (document))
"""
SQL = {
    "length_anchors": f"WITH {SQL_POINTS} SELECT length, area, pieces, documents, {_r('words', 'effective')}, enough, {_r(*ranges.RANGE)} FROM bl",
    "interpolated_ranges": f"WITH {SQL_POINTS} SELECT chunk_id, area, words, judged, {_r(*ranges.RANGE)} FROM rd",
    "verdict_chunks": f"WITH {SQL_POINTS} SELECT chunk_id, document, CAST(words AS INTEGER) AS words, {_r('delta')}, level, {_say.format(j='judged')} AS verdict FROM ck",
    "flagged_chunks": f"WITH {SQL_POINTS} SELECT chunk_id, {_r('delta')}, level, {_r('likeness')}, likeness_level FROM ck WHERE flagged",
    "pooled_ceiling": f"WITH {SQL_POINTS}, g AS (SELECT document, area, count(*) AS chunks, avg(delta) AS delta, {_pool.format(0.5)} AS ceiling FROM rd WHERE judged GROUP BY ALL) SELECT document, area, chunks, {_r('delta', 'ceiling')}, {_level.format(d='delta', c='ceiling')} AS level FROM g",
    "verdict_documents": f"WITH {SQL_POINTS} SELECT document, chunks, chunks_judged, words, {_r('delta', 'ceiling')}, level, {_say.format(j='chunks_judged > 0')} AS verdict, {_r('likeness')}, likeness_level, flagged FROM dc",
    "fail_gate": f"WITH {SQL_POINTS} SELECT * FROM (SELECT document, array_to_string(list_filter([CASE WHEN level >= 1 THEN 'distance' END, CASE WHEN likeness_level >= 2 THEN 'likeness' END, CASE WHEN flagged >= 3 THEN 'flagged' END], lambda x: x IS NOT NULL), ',') AS failed FROM dc) WHERE failed <> ''",
}
QUERIES = {f.__name__: f for f in (length_anchors, interpolated_ranges, verdict_chunks, flagged_chunks, pooled_ceiling, verdict_documents, fail_gate)}
