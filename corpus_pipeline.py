"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir): docs are all that the stage before kept, with the columns of documents, and the
benchmark is read from sf_dir. All but the last stage return the columns of documents. Nulls: null texts and texts
without a letter are rejected by the first stage; null sources are one source of the mix; null ids are documents of
their own but for near-dedup, where a group keeps its smallest id and null comes last. Other columns go along unchanged
up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, langid, line_templates, mixing, resemblance
from inkwell.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang is the predicted one where it was null."""
    model = langid.fit(docs, "text", "lang")
    found = docs.withColumn("__p", langid.predicted(model, F.col("text")))
    return found.where(~F.col("__p.rejected")).withColumn("lang", F.coalesce("lang", "__p.lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring template lines, those of one or two tokens too; n_chars follows. Documents that lose all their lines go."""
    kept = line_templates.line_dedup(docs, least_tokens=1, counts=("__lines", "__gone"))
    return kept.where((F.col("__gone") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8): that with the smallest id, or one of those without an id."""
    return resemblance.least_of_each(docs, "text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"), size=5, least=0.8)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whole or edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, with the words that the mix takes of each."""
    return mixing.mix(docs, (5, 2, 1), 3)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("mixing sources to target weights", mix_sources),
]

#: Language ID, fingerprints and alignment can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
