"""build, Profile and evaluate: the engine's pipelines as bundles of DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions.markdown import markdown_prose, parts as markdown_parts
from inkwell.functions.tokens import WORD
from inkwell.operators import corpus, drift, evaluate as ev, measure, ranges, reference as ref
from inkwell.operators.advice import check_version
from inkwell.operators.edits import unmatched
from inkwell.sources.scratch import materialize


#: What saved profiles are: a major number for what can't be read by other code, a minor one for additions.
VERSION, MINOR = 2, 0
_KEEP = ("chunk_id", "document", "words", "sentences", "paragraphs")
_KEY = ["grp", "metric"]


@dataclass(frozen=True)
class Settings:
    """window: words of a window; markdown: texts are Markdown rather than plain; dedup: drop texts with the same words;
    least_words: shorter chunks are not measured; split: texts become parts at headings or rules, `auto` where there are
    few documents, `always` or `never`; pool: short texts of a document are joined to windows, likewise."""

    window: int = corpus.WINDOW
    markdown: bool = False
    dedup: bool = True
    least_words: int = 1
    split: str = "auto"
    pool: str = "auto"


FEW_DOCUMENTS, SOME_DOCUMENTS, ENOUGH_POOLED = 3, 10, 15


def _prose(settings: Settings):
    return markdown_prose(F.col("text")) if settings.markdown else None


def divided(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs with long texts as documents of their own, one for each part that headings or rules make, `document#3`.

    auto: only under ten documents, and at least three parts a text under three documents, two otherwise.
    """
    if settings.split == "never" or not settings.markdown:
        return docs
    if settings.split == "auto":
        documents = docs.select("document").distinct().limit(SOME_DOCUMENTS).count()
        if documents >= SOME_DOCUMENTS:
            return docs
        least = 3 if documents < FEW_DOCUMENTS else 2
    else:
        least = 2
    cut = docs.withColumn("parts", markdown_parts(F.col("text"), settings.window, least))
    whole = cut.where(F.size("parts") == 0).select(*docs.columns)
    each = cut.where(F.size("parts") > 0).select(*[c for c in docs.columns if c != "text"], F.posexplode("parts").alias("at", "part"))
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit("#"), F.col("at") + 1).alias(c)
    own = [name(c) if c in ("doc_id", "document") else F.col("part.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return whole.select(*[F.col(c).cast("string").alias(c) if c in ("doc_id", "document") else F.col(c) for c in docs.columns]).unionByName(each.select(*own))


def pooled(docs: DataFrame, settings: Settings) -> DataFrame | None:
    """Short texts of each document joined to windows, (doc_id, document, text); None where texts stand alone.

    auto: where half the texts are under a quarter of a window, and 15 windows or more come of it.
    """
    if settings.pool == "never":
        return None
    if settings.pool == "auto":
        words = docs.where(F.regexp_count("text", F.lit(WORD)) > 0).select(F.regexp_count("text", F.lit(WORD)).alias("n"))
        told = corpus.pools_by_default(words, settings.window).crossJoin(words.agg(F.sum("n").alias("all"))).first()  # one row
        if not told["pool"] or (told["all"] or 0) < ENOUGH_POOLED * settings.window:
            return None
    got = corpus.pool(docs, ["document"], "doc_id", "text", settings.window)
    return got.select(F.concat(F.col("document").cast("string"), F.lit("#w"), "window").alias("doc_id"), "document", "text")


def _measured(docs: DataFrame, settings: Settings, cut: bool) -> DataFrame:
    """docs: doc_id, document, text. All surface metrics of windows (of whole texts without cut), a column each."""
    own = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("document").cast("string").alias("document"), "text")
    prep = measure.prepared(own, prose=_prose(settings))
    if cut:
        windows = corpus.windows(prep, settings.window).withColumn("chunk_id", F.concat("chunk_id", F.lit("#w"), "window")).select("chunk_id", "document", "text")
        prep = measure.prepared(windows)
    return measure.measured(prep.where(F.col("n") >= settings.least_words), ("chunk_id", "document"))


def _values(docs: DataFrame, settings: Settings, cut: bool) -> DataFrame:
    """(chunk_id, document, words, sentences, paragraphs, grp, metric, value) of the scored metrics."""
    return measure.long(_measured(docs, settings, cut), _KEEP, scored_only=True)


def pieces_of(docs: DataFrame, settings: Settings, lengths: Sequence[int] = corpus.LENGTHS) -> DataFrame:
    """(chunk_id, document, length, text): texts cut to pieces of about so many words at their blocks and sentences, for ranges by length."""
    own = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("document").cast("string").alias("document"), "text")
    units = corpus.pieces(measure.prepared(own, prose=_prose(settings)), 0)
    size = F.transform("pieces", lambda u: F.struct(u["n"].cast("int").alias("n"), u["block"].cast("int").alias("block")))
    each = [units.select("chunk_id", "document", "pieces", F.lit(n).alias("length"), ranges.cut_points(size, n).alias("cuts")) for n in lengths]
    rows = reduce(DataFrame.unionByName, each).where(F.size("cuts") > 0)
    ends = F.concat(F.slice("cuts", 2, F.size("cuts")), F.array(F.size("pieces")))
    at = F.posexplode(F.zip_with("cuts", ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    one = rows.select("chunk_id", "document", "length", "pieces", at.alias("k", "c"))
    text = F.array_join(F.transform(F.slice("pieces", F.col("c.a") + 1, F.col("c.b") - F.col("c.a")), lambda u: u["text"]), " ")
    return one.select(F.concat("chunk_id", F.lit("#"), "length", F.lit("/"), "k").alias("chunk_id"), "document", "length", text.alias("text"))


def _in_parts(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: chunk_id, document, text. Their paragraphs, the plan of spans, and the spans' scored metrics (chunk_id, document, a, b, words, grp, metric, value)."""
    parts = drift.paragraphs(texts)
    plans = materialize(drift.planned(parts))
    wide = measure.measured(measure.prepared(drift.spans(plans, parts)), ("chunk_id", "a", "b"))
    values = measure.long(wide, ("chunk_id", "a", "b", "words"), scored_only=True)
    return parts, plans, values.join(texts.select("chunk_id", "document"), "chunk_id")


def _relatives(z: DataFrame, rms: DataFrame, points: DataFrame) -> DataFrame:
    """z of spans. (chunk_id, a, b, relative): each span's distance over the bound at its length, null where it isn't judged."""
    keep = ("chunk_id", "a", "b", "words")
    rows = ref.delta(ref.capped(z), rms, keep).where("grp = 'overall'").drop("grp")
    at = ranges.judged(ranges.at_words(rows, points.where("area = 'overall'")), points)
    none = F.lit(None).cast("double")
    return drift.judged_spans(at.withColumns({"likeness": none, "l_p95": none})).select("chunk_id", "a", "b", "relative")


def drift_null(docs: DataFrame, values: DataFrame, summary: DataFrame, rms: DataFrame, points: DataFrame) -> DataFrame:
    """One row, drift.calibrated: what the writer's own texts do, read in parts and judged without their document. Every k-th
    text is read, to about 30 000 words."""
    texts = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("document").cast("string").alias("document"), "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n"))
    chosen = materialize(corpus.every_kth(texts.where("n > 0"), ["document", "chunk_id"], "n").select("chunk_id", "document", "text"))
    _, plans, spans = _in_parts(chosen)
    z = ref.held_out_z(values, summary, others=spans)
    return drift.calibrated(drift.statistics(plans, _relatives(z, rms, points)))


@dataclass(frozen=True)
class Scores:
    """What a profile says of drafts: chunks, areas (distance by area), deviations and signals (their largest metrics)."""

    chunks: DataFrame
    areas: DataFrame
    deviations: DataFrame
    signals: DataFrame

    def documents(self) -> DataFrame:
        """(document, chunks, chunks_judged, words, delta, ceiling, level, verdict, likeness, flagged, reason): chunks pooled."""
        every = self.chunks.groupBy("document").agg(F.count("*").alias("chunks"), F.sum("words").cast("long").alias("words"), F.count_if("judged").alias("chunks_judged"), F.count_if("flagged").alias("flagged"))
        good = self.chunks.where("judged").groupBy("document").agg(F.avg("delta").alias("delta"), ranges.pooled_ceiling(ranges.DELTA_FLOOR).alias("ceiling"), F.avg("likeness").alias("likeness"))
        out = every.join(good, "document", "left").withColumn("level", ranges.delta_level(F.col("delta"), F.col("ceiling")))
        reason = F.when(F.col("chunks_judged") == 0, F.lit("no chunk is long enough")).when(F.col("level") > 0, F.concat(F.lit("distance "), F.round("delta", 2), F.lit(" over "), F.round("ceiling", 2)))
        return out.select("document", "chunks", "chunks_judged", "words", "delta", "ceiling", "level", ranges.verdict(F.col("level"), F.col("chunks_judged") > 0).alias("verdict"), "likeness", "flagged", reason.alias("reason"))

    def failing(self, level: int = 1, flagged: int = 3) -> DataFrame:
        """Documents that a gate turns down."""
        return self.documents().where((F.col("level") >= level) | (F.col("flagged") >= flagged))


@dataclass(frozen=True)
class Profile:
    """A writer's style: summary (grp, metric, n, mean, sd, floor), rms (grp, metric, rms), points (anchors), effects (grp, metric, effect, rms), likeness (one row; empty without a contrast set) and null (one row: how paragraphs of the writer's own texts vary)."""

    summary: DataFrame
    rms: DataFrame
    points: DataFrame
    effects: DataFrame
    likeness: DataFrame
    null: DataFrame
    settings: Settings = Settings()

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "settings"}

    def save(self, path: str) -> None:
        """Each table as Parquet, a few hundred rows whatever the corpus; settings and the version beside them."""
        for name, df in self.tables().items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.summary.sparkSession
        row = [(VERSION, MINOR, json.dumps(asdict(self.settings)))]
        spark.createDataFrame(row, "version int, minor int, settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/made")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Profile:
        """A saved profile, with its settings; one of another major version is refused."""
        made = spark.read.parquet(f"{path}/made").first()
        check_version(made["version"], made["minor"], VERSION, path)
        return cls(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(cls) if f.name != "settings"], Settings(**json.loads(made["settings"])))

    def scores(self, docs: DataFrame, cut: bool = False) -> Scores:
        """docs: doc_id, document, text (chunk_id for doc_id will do)."""
        docs = docs if "doc_id" in docs.columns else docs.withColumnRenamed("chunk_id", "doc_id")
        wide = _measured(docs, self.settings, cut)
        words = wide.where("words > 0").select("chunk_id", "document", "words")
        values = measure.long(wide, ("chunk_id", "document"), scored_only=True)
        z = ref.z_against(values, self.summary)
        areas = ref.delta(z, self.rms)
        delta = areas.where("grp = 'overall'").select("chunk_id", "delta")
        liked = ref.likeness(z, self.effects).select("chunk_id", "likeness")
        at = ranges.judged(ranges.at_words(words, self.points.where("area = 'overall'")), self.points).drop("area")
        got = at.join(delta, "chunk_id", "left").join(liked, "chunk_id", "left")
        level = F.when(F.col("judged"), ranges.delta_level(F.col("delta"), F.greatest("p95", F.lit(ranges.DELTA_FLOOR))))
        rows = got.withColumn("level", level).withColumn("flagged", F.coalesce(F.col("judged") & (F.col("level") >= 2), F.lit(False)))
        rows = rows.select("chunk_id", "document", "words", "judged", "delta", *ranges.RANGE, "level", ranges.verdict(F.col("level"), F.col("judged")).alias("verdict"), "likeness", "flagged")
        return Scores(rows, areas, ref.deviations(z), ref.signals(z, self.effects))

    def drift(self, docs: DataFrame) -> DataFrame:
        """(chunk_id, pos, line, words, excerpt, relative, spans, limit, drifts) of paragraphs of texts of 100 words or more."""
        texts = docs.select(F.col("doc_id" if "doc_id" in docs.columns else "chunk_id").cast("string").alias("chunk_id"), F.col("document").cast("string").alias("document"), "text")
        parts, plans, spans = _in_parts(texts)
        z = ref.z_against(spans, self.summary)
        null = self.null.first()
        tail = null.asDict() if null and null["scale"] is not None else None
        found = drift.flags(drift.statistics(plans, _relatives(z, self.rms, self.points)), plans, null["high"] if tail else 0.0, tail)
        return parts.drop("text").join(found, ["chunk_id", "pos"])

    def score(self, docs: DataFrame, cut: bool = False) -> DataFrame:
        """(chunk_id, document, words, judged, delta, p95, level, verdict, likeness) of chunks."""
        return self.scores(docs, cut).chunks.select("chunk_id", "document", "words", "judged", "delta", "p95", "level", "verdict", "likeness")


def build(docs: DataFrame, contrast: DataFrame | None = None, settings: Settings = Settings()) -> Profile:
    """docs and contrast: doc_id, document, text. Learns a profile; everything is held out by document.

    Texts that repeat another's words go, those of the contrast set that repeat a writer's too. Ranges by length rest on
    pieces cut from the writer's texts.
    """
    from inkwell.plans.reference import delta_range_table

    if settings.dedup:
        both = docs.withColumn("side", F.lit(0))
        both = both if contrast is None else both.unionByName(contrast.withColumn("side", F.lit(1)))
        kept = materialize(corpus.drop_duplicates(both, ["side", "doc_id"]))
        docs, contrast = kept.where("side = 0").drop("side"), None if contrast is None else kept.where("side = 1").drop("side")
    docs = divided(docs, settings)
    joined = pooled(docs, settings)
    rows = materialize(_values(docs if joined is None else joined, settings, joined is None))
    counts = rows.select("chunk_id", "words", "sentences", "paragraphs").distinct().agg(*[F.avg(c).alias(c) for c in ("words", "sentences", "paragraphs")])
    values = rows.select("chunk_id", "document", "grp", "metric", "value")
    summary = materialize(ref.floors(stats.summary(values, ("grp", "metric")), counts))
    z = materialize(ref.held_out_z(values, summary))
    held = ref.held_out_delta(z).select("chunk_id", F.col("grp").alias("area"), "document", F.col("delta").alias("value"))
    held = materialize(held.join(rows.select("chunk_id", "words").distinct(), "chunk_id"))
    size = held.where("area = 'overall'").agg(F.median("words").alias("words"))
    window = delta_range_table(held.select("area", "document", "value")).crossJoin(F.broadcast(size)).select("area", "words", *ranges.RANGE)  # one row
    # Pieces are judged as drafts of their document would be: by the windows of the others.
    cut = materialize(pieces_of(docs, settings))
    short = measure.long(measure.measured(measure.prepared(cut), ("chunk_id", "document", "length")), ("chunk_id", "document", "length", "words"), scored_only=True)
    short_z = ref.held_out_z(values, summary, others=short)
    lengths = ref.delta(short_z, ref.reliability(z), ("chunk_id", "document", "length", "words")).select("length", F.col("grp").alias("area"), "document", F.col("words").cast("double").alias("words"), F.col("delta").alias("value"))
    points = ranges.anchors(ranges.by_length(materialize(lengths)), window)
    spark = docs.sparkSession
    if contrast is None:
        effects = spark.createDataFrame([], "grp string, metric string, effect double, rms double")
        likeness = spark.createDataFrame([], "auc double, target double")
    else:
        others = pooled(contrast, settings) if joined is not None else None
        cz = materialize(ref.z_against(_values(contrast if others is None else others, settings, others is None).select("chunk_id", "document", "grp", "metric", "value"), summary))
        effects = ref.fold(z, cz)
        own = ref.likeness(z, ref.fold_without(z, cz, "reference")).select(F.col("likeness").alias("score"), F.lit(False).alias("positive"))
        other = materialize(ref.likeness(cz, ref.fold_without(z, cz, "contrast")).select(F.col("likeness").alias("score"), F.lit(True).alias("positive")))
        likeness = stats.auc(own.unionByName(other)).crossJoin(other.agg(F.median("score").alias("target")))  # one row each
    rms, points = materialize(ref.reliability(z)), materialize(points)
    null = materialize(drift_null(docs, values, summary, rms, points))
    return Profile(summary, rms, points, materialize(effects), materialize(likeness), null, settings)


@dataclass(frozen=True)
class Evaluation:
    """survival: what edits leave of the strongest effects; edited: likeness of edited chunks under the fold without their
    original; retrained: the AUC where the contrast set holds the edits; unmatched: edits without an original."""

    survival: DataFrame
    edited: DataFrame
    retrained: DataFrame
    unmatched: DataFrame


def evaluate(profile: Profile, originals: DataFrame, edited: DataFrame, reference: DataFrame) -> Evaluation:
    """All: doc_id, document, text; an edit has its original's document."""
    z = lambda docs: materialize(ref.z_against(_values(docs, profile.settings, True).select("chunk_id", "document", "grp", "metric", "value"), profile.summary))
    r, o, e = z(reference), z(originals), z(edited)
    alone = unmatched(edited.select("doc_id", "document"), originals.select("document"), ["document"])
    return Evaluation(ev.signal_survival(profile.effects, r, o, e), ev.fold_scores(r, o, e), ev.retrained(r, o, e), alone)
