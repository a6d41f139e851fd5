"""The tables that queries start from, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.measure import long, prepared, wide
from inkwell.sources import tables

#: Metrics of the shorter analytical queries: five areas, all exact in SQL.
SUBSET = (
    "sentence_words_mean", "short_sentences_pct", "sentence_length_cv", "sentence_length_change_mean", "word_chars_mean", "long_words_pct", "commas_per_1k", "exclamations_per_1k", "second_person_per_1k", "negations_per_1k",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def chunks(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Documents as chunks: chunk_id, document (the source), role (writer, contrast or draft by label), text; all languages, or one."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    role = F.when(F.col("quality") == 1, "writer").when(F.col("quality") == 0, "contrast").otherwise("draft")
    out = docs.where(F.col("lang") == lang) if lang else docs
    return out.join(labels, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), role.alias("role"), "text")


ROLES = ("writer", "contrast", "draft")
_KEEP = ("chunk_id", "document", "role", "words")


def measured(spark: SparkSession, sf_dir: str, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """(chunk_id, document, role, words, sentences, paragraphs) and the subset's metrics, a column each, of chunks of some roles."""
    own = chunks(spark, sf_dir)
    prep = prepared(own if set(roles) == set(ROLES) else own.where(F.col("role").isin(*roles))).withColumns({"words": F.col("n"), "sentences": F.size("lens"), "paragraphs": F.size("prose.paragraphs")})
    return wide(prep, ("sentence_shape", "rhythm", "vocabulary", "punctuation", "voice"), (*_KEEP, "sentences", "paragraphs"), few=True).select(*_KEEP, "sentences", "paragraphs", *SUBSET)


def as_long(rows: DataFrame) -> DataFrame:
    keep = ("chunk_id", "document", "role", "n")
    return long(rows.withColumnRenamed("words", "n").select(*keep, *SUBSET), keep).withColumnRenamed("n", "words")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, document, role, words, grp, metric, value) of the subset's metrics."""
    return as_long(measured(spark, sf_dir))


_W = r"[\pL\pN_]+(?:[''’-][\pL\pN_]+)*"
SQL_BASE = rf"""
base AS (
  SELECT d.doc_id AS chunk_id, d.source AS document, CASE l.quality WHEN 1 THEN 'writer' WHEN 0 THEN 'contrast' ELSE 'draft' END AS role, d.text AS raw,
         trim(regexp_replace(coalesce(d.text, ''), '\s+', ' ', 'g')) AS t
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
lists AS (SELECT *, regexp_extract_all(replace(replace(lower(t), 'ß', 'ss'), '’', ''''), '{_W}') AS tok FROM base),
toks AS (SELECT chunk_id, unnest(tok) AS tok, unnest(range(len(tok))) AS pos FROM lists),
pieces AS (SELECT chunk_id, unnest(p) AS piece, unnest(range(len(p))) AS pos
           FROM (SELECT chunk_id, string_split(regexp_replace(t, '([.!?]["''”’)\]]?)\s+(["“''‘(\[]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS p FROM base)),
islands AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY pos) AS g
            FROM (SELECT *, coalesce(regexp_matches(lag(piece) OVER w, '(?i)(?:^|[^\pL\pN_])(?:e\.g|i\.e|vs|mr|mrs|ms|dr|st|jr|sr|fig|approx)\.$')
                            OR (regexp_matches(lag(piece) OVER w, '(?:^|[^\pL\pN_])(?:No|Nos|[Vv]ol|pp|[Cc]h)\.$') AND regexp_matches(piece, '^[0-9]')), false) AS glued
                  FROM pieces WINDOW w AS (PARTITION BY chunk_id ORDER BY pos))),
sents AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY g) - 1 AS pos, s, CAST(len(regexp_extract_all(s, '{_W}')) AS INTEGER) AS n
          FROM (SELECT chunk_id, g, string_agg(piece, ' ' ORDER BY pos) AS s FROM islands GROUP BY chunk_id, g) WHERE regexp_matches(s, '[\pL\pN_]')),
shape AS (SELECT chunk_id, avg(n) AS sentence_words_mean, median(n) AS sentence_words_median, stddev_pop(n) AS sentence_words_sd,
                 100.0::DOUBLE * count(*) FILTER (n <= 8) / count(*) AS short_sentences_pct, 100.0::DOUBLE * count(*) FILTER (n >= 30) / count(*) AS long_sentences_pct,
                 stddev_pop(n) / nullif(avg(n), 0) AS sentence_length_cv, avg(d) AS sentence_length_change_mean, count(*) AS sentences
          FROM (SELECT *, abs(n - lag(n) OVER (PARTITION BY chunk_id ORDER BY pos)) AS d FROM sents) GROUP BY chunk_id),
words AS (SELECT chunk_id, len(tok) AS n, list_avg(list_transform(tok, lambda x: length(x))) AS word_chars_mean, 100.0::DOUBLE * len(list_filter(tok, lambda x: length(x) >= 7)) / nullif(len(tok), 0) AS long_words_pct FROM lists)
"""


def per_1k(count: str) -> str:
    return f"CASE WHEN len(tok) > 0 THEN ({count}) * (1000.0::DOUBLE / len(tok)) END"


def count_in(words: tuple[str, ...], ends: tuple[str, ...] = ()) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    more = "".join(" OR ends_with(x, '" + e.replace("'", "''") + "')" for e in ends)
    return f"len(list_filter(tok, lambda x: x IN ({quoted}){more}))"


def matches(pattern: str, column: str = "t") -> str:
    return f"len(regexp_extract_all({column}, '" + pattern.replace("'", "''") + "'))"


from inkwell.functions import lexicon as lx  # noqa: E402

SQL_VALUES = rf"""{SQL_BASE},
marks AS (SELECT chunk_id, {per_1k(matches(','))} AS commas_per_1k, {per_1k(matches('!'))} AS exclamations_per_1k,
                 {per_1k(count_in(lx.SECOND_PERSON))} AS second_person_per_1k, {per_1k(count_in(lx.NEGATIONS, ("n't",)))} AS negations_per_1k FROM lists),
vals AS (
  SELECT chunk_id, document, role, CAST(w.n AS INTEGER) AS words, m.grp, m.metric, m.value FROM base JOIN words w USING (chunk_id) LEFT JOIN shape s USING (chunk_id) JOIN marks k USING (chunk_id),
  LATERAL (VALUES ('sentence_shape', 'sentence_words_mean', s.sentence_words_mean), ('sentence_shape', 'short_sentences_pct', s.short_sentences_pct),
    ('rhythm', 'sentence_length_cv', s.sentence_length_cv), ('rhythm', 'sentence_length_change_mean', s.sentence_length_change_mean),
    ('vocabulary', 'word_chars_mean', w.word_chars_mean), ('vocabulary', 'long_words_pct', w.long_words_pct), ('punctuation', 'commas_per_1k', k.commas_per_1k),
    ('punctuation', 'exclamations_per_1k', k.exclamations_per_1k), ('voice', 'second_person_per_1k', k.second_person_per_1k), ('voice', 'negations_per_1k', k.negations_per_1k)) m(grp, metric, value)
  WHERE m.value IS NOT NULL)
"""
