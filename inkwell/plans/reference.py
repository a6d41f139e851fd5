"""Queries over reference statistics, Delta and likeness. Writers are the reference, their source is the document."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.operators import evaluate as ev, ranges, reference as ref
from inkwell.plans.base import ROLES, SQL_VALUES, SUBSET, as_long, measured
from inkwell.plans.measure import _rounded
from inkwell.sources.scratch import materialize


class Setup:
    """What the queries share: values by role, the summary with floors, held-out z of writers, z of the others.

    Each is computed when a query asks for it, of the roles that the query reads.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, roles: tuple[str, ...] = ROLES):
        self.rows, self.roles = materialize(measured(spark, sf_dir, roles)), roles
        self.words = self.rows.where(F.greatest(*[F.col(m).isNotNull() for m in SUBSET])).select("chunk_id", "role", "words")

    def _values(self, role: str) -> DataFrame:
        assert role in self.roles, role
        return as_long(self.rows).where(F.col("role") == role).drop("role", "words")

    @cached_property
    def writer(self) -> DataFrame:
        return self._values("writer")

    @cached_property
    def contrast(self) -> DataFrame:
        return self._values("contrast")

    @cached_property
    def drafts(self) -> DataFrame:
        return self._values("draft")

    @cached_property
    def summary(self) -> DataFrame:
        return stats.summary(self.writer, ("grp", "metric"))

    @cached_property
    def floors(self) -> DataFrame:
        counts = self.rows.where("role = 'writer'").agg(F.avg("words").alias("words"), F.avg("sentences").alias("sentences"), F.avg("paragraphs").alias("paragraphs"))
        return materialize(ref.floors(self.summary, counts))

    @cached_property
    def z(self) -> DataFrame:
        return materialize(ref.held_out_z(self.writer, self.floors))

    @cached_property
    def rms(self) -> DataFrame:
        return ref.reliability(self.z)

    @cached_property
    def contrast_z(self) -> DataFrame:
        return ref.z_against(self.contrast, self.floors)

    @cached_property
    def draft_z(self) -> DataFrame:
        return ref.z_against(self.drafts, self.floors)


def _query(*roles: str, setup: type[Setup] = Setup):
    """A query over what is shared, which reads chunks of some roles."""
    def of(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(fn(setup(spark, sf_dir, roles)))

        query.__name__, query.__doc__, query.roles = fn.__name__, fn.__doc__, roles
        return query

    return of


@_query("writer")
def metric_summary(s: Setup) -> DataFrame:
    """n, mean, sd, cv, min and max of each metric over the writers' chunks."""
    return s.summary


@_query("writer")
def resolution_floors(s: Setup) -> DataFrame:
    """The smallest meaningful spread of each metric."""
    return s.floors.select("grp", "metric", "floor")


@_query("writer")
def held_out_z(s: Setup) -> DataFrame:
    """z of each writer chunk against the chunks of other documents."""
    return s.z


@_query("writer")
def reliability_rms(s: Setup) -> DataFrame:
    """Root mean square of held-out z, and the weight that it gives."""
    return s.rms.withColumn("weight", 1.0 / F.pow(F.greatest("rms", F.lit(1.0)), F.lit(2.0)))


@_query("writer", "contrast")
def z_against_reference(s: Setup) -> DataFrame:
    """z of contrast chunks against the stored summary."""
    return s.contrast_z


@_query("writer", "draft")
def delta_by_area(s: Setup) -> DataFrame:
    """Distance of drafts by area and overall."""
    return ref.delta(s.draft_z, s.rms)


@_query("writer")
def held_out_delta(s: Setup) -> DataFrame:
    """Distance of writer chunks, everything learned without their document."""
    return ref.held_out_delta(s.z)


@_query("writer", "draft")
def deviations_topk(s: Setup) -> DataFrame:
    """The eight largest differences of each draft."""
    return ref.deviations(s.draft_z)


def _deltas(s: Setup) -> DataFrame:
    return ref.held_out_delta(s.z).select(F.col("grp").alias("area"), "document", F.col("delta").alias("value")).transform(materialize)


@_query("writer")
def icc_effective(s: Setup) -> DataFrame:
    """Intraclass correlation and effective count of held-out distances, by area."""
    return stats.by_document(_deltas(s), ("area",))


def delta_range_table(deltas: DataFrame) -> DataFrame:
    """median, mean (upper bound), p95, p95_bound, p99, similarity and max of (area, document, value)."""
    g = stats.by_document(deltas, ("area",))
    ranged = deltas.join(g.select("area", stats.upper_share(0.95, F.col("effective")).alias("bound")), "area")
    ranks = stats.nearest_rank(ranged, ("area", "bound"), {"p95": F.lit(0.95), "p99": F.lit(0.99), "p95_bound": F.col("bound")})
    middle = deltas.groupBy("area").agg(F.median("value").alias("median"), F.max("value").alias("max"))
    return g.select("area", stats.upper_mean(g).alias("mean"), stats.similarity().alias("similarity")).join(ranks.drop("bound"), "area").join(middle, "area")


@_query("writer")
def delta_range(s: Setup) -> DataFrame:
    """The range that held-out distances of the reference itself fall in, by area."""
    return delta_range_table(_deltas(s))


@_query("writer", "contrast")
def contrast_effects(s: Setup) -> DataFrame:
    """What tells contrast from writer chunks, strongest first, and its weight."""
    return ref.fold(s.z, s.contrast_z)


@_query("writer", "contrast")
def effects_without(s: Setup) -> DataFrame:
    """Effects learned without each writer document."""
    return ref.fold_without(s.z, s.contrast_z, "reference", every_metric=True)


def _loo(s: Setup) -> DataFrame:
    a = ref.likeness(s.z, ref.fold_without(s.z, s.contrast_z, "reference")).withColumn("side", F.lit("writer"))
    b = ref.likeness(s.contrast_z, ref.fold_without(s.z, s.contrast_z, "contrast")).withColumn("side", F.lit("contrast"))
    return materialize(a.unionByName(b))


@_query("writer", "contrast")
def likeness_loo(s: Setup) -> DataFrame:
    """Likeness of writer and contrast chunks, the fold learned without their document."""
    return _loo(s)


@_query(*ROLES)
def likeness_signals_topk(s: Setup) -> DataFrame:
    """The five metrics that make most of a draft's likeness to the contrast set."""
    return ref.signals(s.draft_z, ref.fold(s.z, s.contrast_z))


@_query("writer", "contrast")
def auc_rank(s: Setup) -> DataFrame:
    """How well cross-validated likeness tells contrast from writer chunks."""
    return stats.auc(_loo(s).select(F.col("likeness").alias("score"), (F.col("side") == "contrast").alias("positive")))


@_query("writer", "contrast")
def length_baseline(s: Setup) -> DataFrame:
    """How well the word count alone does, with its direction and medians."""
    w = s.words.where("role IN ('writer', 'contrast')")
    got = stats.auc(w.select(F.col("words").cast("double").alias("score"), (F.col("role") == "contrast").alias("positive")))
    medians = w.agg(F.median(F.when(F.col("role") == "writer", F.col("words"))).alias("writer_median"), F.median(F.when(F.col("role") == "contrast", F.col("words"))).alias("contrast_median"))
    return got.crossJoin(medians).select(F.greatest("auc", 1 - F.col("auc")).alias("auc"), F.when(F.col("auc") >= 0.5, "longer").otherwise("shorter").alias("direction"), "writer_median", "contrast_median")


@_query("writer", "draft")
def average_z(s: Setup) -> DataFrame:
    """Mean z of each document's drafts, by metric."""
    return ref.average_z(s.draft_z, s.drafts, s.summary)


@_query("writer")
def mean_ceilings(s: Setup) -> DataFrame:
    """The bound of a mean over one to ten chunks, by area."""
    rows = delta_range_table(_deltas(s)).withColumn("chunks", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return rows.select("area", "chunks", ranges.mean_ceiling(F.col("mean"), F.col("p95"), F.col("similarity"), F.col("chunks"), ranges.DELTA_FLOOR).alias("ceiling"))


@_query(*ROLES)
def fold_scores(s: Setup) -> DataFrame:
    """Likeness of drafts under the fold learned without the contrast texts of their document."""
    return ev.fold_scores(s.z, s.contrast_z, s.draft_z)


def z_sql(value: str, n: str, mean: str, sd: str, floor: str) -> str:
    spread = f"greatest(coalesce({sd}, 0), coalesce({floor}, 0))"
    return f"CASE WHEN {n} < 2 THEN NULL WHEN abs({value} - {mean}) <= greatest(1e-6 * greatest(abs({value}), abs({mean})), 1e-6) THEN 0 WHEN {spread} > 0 THEN ({value} - {mean}) / {spread} ELSE 3.0 * sign({value} - {mean}) END"


SQL_SETUP = rf"""{SQL_VALUES},
ref AS (SELECT * FROM vals WHERE role = 'writer'), con AS (SELECT * FROM vals WHERE role = 'contrast'), dra AS (SELECT * FROM vals WHERE role = 'draft'),
summ AS (SELECT grp, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM ref GROUP BY grp, metric),
units AS (SELECT avg(w.n) AS words, avg(coalesce(s.sentences, 0)) AS sentences FROM base JOIN words w USING (chunk_id) LEFT JOIN shape s USING (chunk_id) WHERE role = 'writer'),
fl AS (SELECT summ.*, CASE WHEN metric LIKE '%\_per\_1k' ESCAPE '\' THEN 500.0 / words WHEN metric = 'long_words_pct' THEN 50.0 / words WHEN metric = 'short_sentences_pct' THEN 50.0 / sentences ELSE 0.05 * abs(mean) END AS floor FROM summ, units),
part AS (SELECT grp, metric, document, count(value) AS dn, sum(value) AS d1, sum(value * value) AS d2 FROM ref GROUP BY ALL),
tot AS (SELECT grp, metric, sum(dn) AS n, sum(d1) AS s1, sum(d2) AS s2 FROM part GROUP BY ALL),
loo AS (SELECT r.chunk_id, r.document, r.grp, r.metric, r.value, t.n - p.dn AS n, (t.s1 - p.d1) / nullif(t.n - p.dn, 0) AS mean, (t.s2 - p.d2) AS s2, f.floor
        FROM ref r JOIN tot t USING (grp, metric) JOIN part p USING (grp, metric, document) JOIN fl f USING (grp, metric)),
lv AS (SELECT *, (s2 - n * mean * mean) / nullif(n - 1, 0) AS v FROM loo),
hz AS (SELECT * FROM (SELECT chunk_id, document, grp, metric, {z_sql('value', 'n', 'mean', 'sd', 'floor')} AS z FROM (SELECT *, CASE WHEN v > 1e-12 * greatest(1, mean * mean) THEN sqrt(v) ELSE 0 END AS sd FROM lv)) WHERE z IS NOT NULL),
rms AS (SELECT grp, metric, sqrt(sum(z * z) / count(z)) AS rms FROM hz GROUP BY ALL),
cz AS (SELECT * FROM (SELECT c.chunk_id, c.document, grp, metric, {z_sql('c.value', 'f.n', 'f.mean', 'f.sd', 'f.floor')} AS z FROM con c JOIN fl f USING (grp, metric)) WHERE z IS NOT NULL),
dz AS (SELECT * FROM (SELECT c.chunk_id, c.document, grp, metric, {z_sql('c.value', 'f.n', 'f.mean', 'f.sd', 'f.floor')} AS z FROM dra c JOIN fl f USING (grp, metric)) WHERE z IS NOT NULL),
rw AS (SELECT grp, metric, document, CASE WHEN n > dn THEN sqrt(greatest(0, s2 - d2) / (n - dn)) END AS rms
       FROM (SELECT grp, metric, document, count(z) AS dn, sum(z * z) AS d2, sum(count(z)) OVER (PARTITION BY grp, metric) AS n, sum(sum(z * z)) OVER (PARTITION BY grp, metric) AS s2 FROM hz GROUP BY grp, metric, document)),
ha AS (SELECT chunk_id, document, grp, sum(w * a) / sum(w) AS delta FROM (SELECT hz.*, CASE WHEN rms IS NULL THEN 1.0 ELSE 1.0 / greatest(rms, 1) ^ 2 END AS w, CASE WHEN rms IS NULL THEN least(abs(z), 3.0) ELSE abs(z) END AS a FROM hz LEFT JOIN rw USING (grp, metric, document)) GROUP BY ALL),
hd AS (SELECT * FROM ha UNION ALL SELECT chunk_id, document, 'overall', avg(delta) FROM ha GROUP BY ALL),
docs AS (SELECT grp AS area, document, count(*) AS c, avg(delta) AS m, var_pop(delta) AS w FROM hd GROUP BY ALL),
anova AS (SELECT area, sum(c) AS count, count(*) AS documents, sum(c * m) / sum(c) AS mean, sum(c * c) AS squares, sum(c * w) AS within, sum(c * m * m) - sum(c * m) ^ 2 / sum(c) AS between FROM docs GROUP BY area),
icc AS (SELECT *, CASE WHEN documents >= 2 AND count > documents THEN CASE WHEN mb + (n0 - 1) * mw > 0 THEN least(greatest((mb - mw) / (mb + (n0 - 1) * mw), 0), 1) ELSE 0 END END AS icc, sqrt((within + greatest(between, 0)) / nullif(count - 1, 0)) AS sd
        FROM (SELECT *, CASE WHEN documents < 2 THEN count ELSE (count - squares / count) / (documents - 1) END AS n0, greatest(between, 0) / nullif(documents - 1, 0) AS mb, within / nullif(count - documents, 0) AS mw FROM anova)),
eff AS (SELECT *, CASE WHEN documents < 2 THEN least(count, 1) ELSE count / (1 + (n0 - 1) * coalesce(icc, 0)) END AS effective FROM icc),
fold AS (SELECT grp, metric, (mc - mr) / greatest(rms, 1) AS effect, rms FROM (SELECT grp, metric, avg(z) AS mr FROM hz GROUP BY ALL) JOIN (SELECT grp, metric, avg(z) AS mc FROM cz GROUP BY ALL) USING (grp, metric) JOIN rms USING (grp, metric)),
rp AS (SELECT grp, metric, document, count(z) AS dn, sum(z) AS d1, sum(z * z) AS d2 FROM hz GROUP BY ALL), rt AS (SELECT grp, metric, sum(dn) AS n, sum(d1) AS s1, sum(d2) AS s2 FROM rp GROUP BY ALL),
cp AS (SELECT grp, metric, document, count(z) AS dn, sum(z) AS d1 FROM cz GROUP BY ALL), ct AS (SELECT grp, metric, sum(dn) AS cn, sum(d1) AS c1 FROM cp GROUP BY ALL),
fr AS (SELECT document, grp, metric, (c1 / cn - (s1 - coalesce(d1, 0)) / (n - coalesce(dn, 0))) / greatest(sqrt(greatest(0, s2 - coalesce(d2, 0)) / (n - coalesce(dn, 0))), 1) AS effect, sqrt(greatest(0, s2 - coalesce(d2, 0)) / (n - coalesce(dn, 0))) AS rms
       FROM rt JOIN ct USING (grp, metric) CROSS JOIN (SELECT DISTINCT document FROM hz) LEFT JOIN rp USING (grp, metric, document) WHERE n > coalesce(dn, 0)),
fc AS (SELECT document, grp, metric, ((c1 - coalesce(d1, 0)) / (cn - coalesce(dn, 0)) - s1 / n) / greatest(sqrt(s2 / n), 1) AS effect, sqrt(s2 / n) AS rms
       FROM rt JOIN ct USING (grp, metric) CROSS JOIN (SELECT DISTINCT document FROM cz) LEFT JOIN cp USING (grp, metric, document) WHERE cn > coalesce(dn, 0)),
liked AS (SELECT chunk_id, document, 'writer' AS side, sum(effect * effect * greatest(0, sign(effect) * z) / greatest(rms, 1)) / nullif(sum(effect * effect), 0) AS likeness FROM hz JOIN fr USING (grp, metric, document) GROUP BY ALL
          UNION ALL SELECT chunk_id, document, 'contrast', sum(effect * effect * greatest(0, sign(effect) * z) / greatest(rms, 1)) / nullif(sum(effect * effect), 0) FROM cz JOIN fc USING (grp, metric, document) GROUP BY ALL)
"""
_T = [repr(stats.t_value(0.9, d)) for d in (1, 2)]
_z = stats.UPPER_Z
_t = f"CASE WHEN documents - 1 <= 1 THEN {_T[0]} WHEN documents - 1 <= 2 THEN {_T[1]} ELSE {_z} + {(_z**3 + _z) / 4} / (documents - 1) + {(5 * _z**5 + 16 * _z**3 + 3 * _z) / 96} / (documents - 1) ^ 2 + {(3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384} / (documents - 1) ^ 3 + {(79 * _z**9 + 776 * _z**7 + 1482 * _z**5 - 1920 * _z**3 - 945 * _z) / 92160} / (documents - 1) ^ 4 END"


def rank_sql(share: str) -> str:
    """Nearest rank of the ordered list d of hd for an area."""
    return f"d[CAST(round_even({share} * (len(d) - 1), 0) AS BIGINT) + 1]"


SQL_RANGE = f"""range_ AS (
  SELECT area, CASE WHEN count < 2 THEN mean ELSE mean + ({_t}) * sd / sqrt(greatest(effective, 1)) END AS mean,
         greatest(CASE WHEN documents < 10 THEN greatest(coalesce(icc, 0), 0.2) ELSE coalesce(icc, 0) END, 0.05) AS similarity,
         {rank_sql('0.95::DOUBLE')} AS p95, {rank_sql('0.99::DOUBLE')} AS p99, {rank_sql(f'least(0.95::DOUBLE + {_z} * sqrt(0.95::DOUBLE * (1 - 0.95::DOUBLE) / greatest(effective, 1)), 1)')} AS p95_bound, median, max
  FROM eff JOIN (SELECT grp AS area, list(delta ORDER BY delta) AS d, median(delta) AS median, max(delta) AS max FROM hd GROUP BY grp) USING (area))"""
_r = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
SQL = {
    "metric_summary": f"WITH {SQL_SETUP} SELECT grp, metric, n, {_r('mean', 'sd')}, round(sd / nullif(abs(mean), 0), 6) AS cv, {_r('min', 'max')} FROM summ",
    "resolution_floors": f"WITH {SQL_SETUP} SELECT grp, metric, {_r('floor')} FROM fl",
    "held_out_z": f"WITH {SQL_SETUP} SELECT chunk_id, document, grp, metric, {_r('z')} FROM hz",
    "reliability_rms": f"WITH {SQL_SETUP} SELECT grp, metric, {_r('rms')}, round(1.0 / greatest(rms, 1) ^ 2, 6) AS weight FROM rms",
    "z_against_reference": f"WITH {SQL_SETUP} SELECT chunk_id, document, grp, metric, {_r('z')} FROM cz",
    "delta_by_area": f"WITH {SQL_SETUP}, a AS (SELECT chunk_id, document, grp, sum(abs(z) / greatest(rms, 1) ^ 2) / sum(1 / greatest(rms, 1) ^ 2) AS delta FROM dz JOIN rms USING (grp, metric) GROUP BY ALL) SELECT chunk_id, document, grp, {_r('delta')} FROM a UNION ALL SELECT chunk_id, document, 'overall', round(avg(delta), 6) FROM a GROUP BY chunk_id, document",
    "held_out_delta": f"WITH {SQL_SETUP} SELECT chunk_id, document, grp, {_r('delta')} FROM hd",
    "icc_effective": f"WITH {SQL_SETUP} SELECT area, CAST(count AS BIGINT) AS count, documents, {_r('mean', 'sd', 'n0', 'icc', 'effective')} FROM eff",
    "delta_range": f"WITH {SQL_SETUP}, {SQL_RANGE} SELECT area, {_r('mean', 'similarity', 'p95', 'p99', 'p95_bound', 'median', 'max')} FROM range_",
    "deviations_topk": f"WITH {SQL_SETUP} SELECT chunk_id, grp, metric, {_r('z')}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY abs(z) DESC, grp, metric) AS rank FROM dz) WHERE rank <= 8",
    "contrast_effects": f"WITH {SQL_SETUP} SELECT grp, metric, {_r('effect', 'rms')} FROM fold",
    "effects_without": f"WITH {SQL_SETUP} SELECT document, grp, metric, {_r('effect', 'rms')} FROM fr",
    "likeness_loo": f"WITH {SQL_SETUP} SELECT chunk_id, document, side, {_r('likeness')} FROM liked",
    "likeness_signals_topk": f"WITH {SQL_SETUP}, s AS (SELECT chunk_id, grp, metric, z, effect * effect * greatest(0, sign(effect) * z) / greatest(rms, 1) AS part, sum(effect * effect) OVER (PARTITION BY chunk_id) AS w FROM dz JOIN fold USING (grp, metric)), k AS (SELECT *, part / w AS share, row_number() OVER (PARTITION BY chunk_id ORDER BY part / w DESC, grp DESC, metric DESC, z DESC) AS rank FROM s WHERE part > 0) SELECT chunk_id, grp, metric, {_r('z', 'share')}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5",
    "average_z": f"WITH {SQL_SETUP}, h AS (SELECT document, grp, metric, avg(value) AS here FROM dra GROUP BY ALL) SELECT document, grp, metric, round(CASE WHEN coalesce(any_value(sd), 0) <> 0 THEN avg(z) WHEN coalesce(any_value(here), 0) < coalesce(any_value(mean), 0) THEN -avg(abs(z)) ELSE avg(abs(z)) END, 6) AS z FROM dz LEFT JOIN h USING (document, grp, metric) LEFT JOIN summ USING (grp, metric) GROUP BY ALL",
    "mean_ceilings": f"WITH {SQL_SETUP}, {SQL_RANGE} SELECT area, CAST(chunks AS INTEGER) AS chunks, round(greatest(CASE WHEN chunks = 1 THEN p95 ELSE mean + greatest(p95 - mean, 0) * sqrt(similarity + (1 - similarity) / chunks) END, 0.5::DOUBLE), 6) AS ceiling FROM range_, range(1, 11) r(chunks)",
    "fold_scores": f"WITH {SQL_SETUP}, f AS (SELECT chunk_id, sum(effect * effect * greatest(0, sign(effect) * z) / greatest(rms, 1)) / nullif(sum(effect * effect), 0) AS likeness FROM dz JOIN fc USING (grp, metric, document) GROUP BY 1) SELECT d.chunk_id, d.document, round(likeness, 6) AS likeness FROM (SELECT DISTINCT chunk_id, document FROM dz) d LEFT JOIN f USING (chunk_id)",
    "auc_rank": f"WITH {SQL_SETUP}, p AS (SELECT likeness AS s FROM liked WHERE side = 'contrast' AND likeness IS NOT NULL), q AS (SELECT likeness AS s FROM liked WHERE side = 'writer' AND likeness IS NOT NULL) SELECT round(avg(CASE WHEN p.s > q.s THEN 1.0::DOUBLE WHEN p.s = q.s THEN 0.5::DOUBLE ELSE 0 END), 6) AS auc FROM p CROSS JOIN q",
    "length_baseline": f"WITH {SQL_SETUP}, c AS (SELECT DISTINCT chunk_id, role, words FROM vals WHERE role <> 'draft'), a AS (SELECT avg(CASE WHEN p.words > q.words THEN 1.0::DOUBLE WHEN p.words = q.words THEN 0.5::DOUBLE ELSE 0 END) AS auc FROM c p CROSS JOIN c q WHERE p.role = 'contrast' AND q.role = 'writer') SELECT round(greatest(auc, 1 - auc), 6) AS auc, CASE WHEN auc >= 0.5 THEN 'longer' ELSE 'shorter' END AS direction, (SELECT median(words) FROM c WHERE role = 'writer') AS writer_median, (SELECT median(words) FROM c WHERE role = 'contrast') AS contrast_median FROM a",
}
QUERIES = {f.__name__: f for f in (metric_summary, resolution_floors, held_out_z, reliability_rms, z_against_reference, delta_by_area, held_out_delta, deviations_topk, icc_effective, delta_range, contrast_effects, effects_without, likeness_loo, likeness_signals_topk, auc_rank, length_baseline, average_z, mean_ceilings, fold_scores)}
