"""Queries over sample sizes, names, edits and their originals, spans of paragraphs, match offsets, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions.html import looks_like_html, to_markdown
from inkwell.functions.tokens import WORD
from inkwell.operators import advice, corpus, drift, edits, measure as m
from inkwell.plans.base import SQL_BASE, _W, chunks, matches, table
from inkwell.plans.measure import _prep


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writers' chunks: document, words."""
    return _prep(spark, sf_dir).where("role = 'writer'").select("document", F.col("n").alias("words"))


def reference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks, documents and words the writers have."""
    return advice.totals(_sizes(spark, sf_dir))


def thin_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the writers' chunks may be too few to trust."""
    return advice.thin(_sizes(spark, sf_dir))


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (source and size) that texts of several languages, or several of one, claim."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(":"), "n_chars").alias("name"), F.coalesce("lang", F.lit("none")).alias("path"))
    return advice.repeated_names(docs, "name", "path")


def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by source and size, repeats with their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(":"), "n_chars").alias("name"))
    return advice.numbered(docs, "name", ["doc_id"]).select("doc_id", "unique")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Writers as originals and contrast texts as edits, with two keys: the source and size, and the first words."""
    rows = chunks(spark, sf_dir).select("chunk_id", "role", F.concat("document", F.lit(":"), F.length("text")).alias("stem"), F.md5(F.substring("text", 1, 20)).alias("start"))
    return rows.where("role = 'writer'").drop("role"), rows.where("role = 'contrast'").drop("role")


def covered_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals that share a key with an edit."""
    originals, edited = _sides(spark, sf_dir)
    return edits.covered(originals, edited, ["stem", "start"]).select("chunk_id")


def unmatched_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits without an original."""
    originals, edited = _sides(spark, sf_dir)
    return edits.unmatched(edited, originals, ["stem", "start"]).select("chunk_id")


def edits_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as edits of themselves: what each is compared with once documents that repeat another are gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    repeats = corpus.duplicates(docs, ["doc_id"]).where("first.doc_id <> doc_id").select(F.col("doc_id").alias("dropped"), F.col("first.doc_id").alias("kept"))
    rows = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key")).distinct()
    return edits.edits_of_repeats(rows, repeats)


def drift_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold a word: place, line and words."""
    return drift.paragraphs(chunks(spark, sf_dir)).select("chunk_id", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), "words")


def span_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two spans of each line of documents of 100 words or more."""
    got = drift.planned(drift.paragraphs(chunks(spark, sf_dir)))
    return got.select("chunk_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "a1", "b1", "a2", "b2")])


#: Patterns that DuckDB's regular expressions hold as well.
COUNTED = ("commas", "semicolons", "colons", "parentheses", "questions", "exclamations", "ellipses", "hedges", "boosters", "llm_markers", "not_just_but")


def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the counting patterns in each document: how many, and their characters by offsets."""
    got = m.match_spans(_prep(spark, sf_dir), metrics=COUNTED)
    return got.groupBy("chunk_id", "metric").agg(F.count("*").alias("matches"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: words, and whether the source reads as HTML."""
    got = table(spark, sf_dir, "pages").select("page_id", looks_like_html(F.col("html")).alias("is_html"), to_markdown(F.col("html")).alias("text"))
    return got.select("page_id", "is_html", "text", F.regexp_count("text", F.lit(WORD)).alias("words"))


_key = rf"CASE WHEN len(regexp_extract_all(text, '{_W}')) >= 20 THEN array_to_string(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '{_W}'), ' ') END"
_S = "s AS (SELECT doc_id, source || ':' || length(text) AS stem, md5(substr(text, 1, 20)) AS start, quality FROM documents JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"
_P = rf"""par AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY line) - 1 AS pos, line, words FROM (
  SELECT doc_id AS chunk_id, i AS line, CAST(len(regexp_extract_all(x, '{_W}')) AS BIGINT) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE words > 0)"""
_spans = " UNION ALL ".join(
    f"SELECT chunk_id, '{c}' AS metric, regexp_extract_all({'t' if m.SPANS[c][0] == 't' else 'replace(t, chr(8217), chr(39))'}, '" + m.SPANS[c][1].replace("'", "''") + "') AS f FROM base" for c in COUNTED
)
SQL = {
    "reference_totals": f"WITH {SQL_BASE} SELECT count(*) AS chunks, count(DISTINCT document) AS documents, CAST(coalesce(sum(len(tok)), 0) AS BIGINT) AS words FROM lists WHERE role = 'writer'",
    "thin_reference": f"WITH {SQL_BASE}, g AS (SELECT document, count(*) AS c, sum(len(tok)) AS w FROM lists WHERE role = 'writer' GROUP BY 1), a AS (SELECT count(*) AS d, coalesce(sum(c), 0) AS c, coalesce(sum(w), 0) AS w, coalesce(max(c), 0) AS l FROM g) SELECT code, CAST(f AS BIGINT) AS found, CAST(n AS BIGINT) AS wanted FROM a, LATERAL (VALUES ('documents', d, 2, d < 2), ('chunks', c, 15, c < 15), ('dominant', c - l, 20, d >= 2 AND l > c - l AND (c - l < 20 OR d < 3)), ('words', w, 20000, w < 20000)) v(code, f, n, yes) WHERE yes",
    "repeated_names": "SELECT source || ':' || n_chars AS name, count(DISTINCT coalesce(lang, 'none')) AS inputs, count(*) AS texts FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "numbered_names": "SELECT doc_id, CASE WHEN r > 1 THEN name || ' (' || r || ')' ELSE name END AS \"unique\" FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM (SELECT doc_id, source || ':' || n_chars AS name FROM documents))",
    "covered_originals": f"WITH {_S} SELECT doc_id AS chunk_id FROM s WHERE quality = 1 AND (stem IN (SELECT stem FROM s WHERE quality = 0 AND stem IS NOT NULL) OR start IN (SELECT start FROM s WHERE quality = 0 AND start IS NOT NULL))",
    "unmatched_edits": f"WITH {_S} SELECT doc_id AS chunk_id FROM s WHERE quality = 0 AND NOT coalesce(stem IN (SELECT stem FROM s WHERE quality = 1 AND stem IS NOT NULL), false) AND NOT coalesce(start IN (SELECT start FROM s WHERE quality = 1 AND start IS NOT NULL), false)",
    "edits_of_repeats": f"WITH k AS (SELECT doc_id, {_key} AS k FROM documents), f AS (SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY k) AS kept FROM k WHERE k IS NOT NULL), e AS (SELECT DISTINCT l.doc_id AS id, l.doc_id AS key, kept FROM labels l LEFT JOIN (SELECT * FROM f WHERE key <> kept) ON key = l.doc_id WHERE l.doc_id IS NOT NULL), own AS (SELECT key FROM e WHERE kept IS NULL) SELECT id, key, CASE WHEN kept IS NULL THEN key WHEN fresh THEN kept END AS pair, CASE WHEN kept IS NULL THEN 'own' WHEN fresh THEN 'copy' ELSE 'doubled' END AS note FROM (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY id) = 1 AND kept NOT IN (SELECT key FROM own) AS fresh FROM e)",
    "drift_paragraphs": f"WITH {_P} SELECT chunk_id, pos, line, words FROM par",
    "span_plan": f"""WITH {_P}, n AS (SELECT chunk_id, count(*) AS n FROM par GROUP BY 1 HAVING sum(words) >= 100),
pre AS (SELECT chunk_id, 0 AS k, 0 AS s FROM n UNION ALL SELECT chunk_id, pos + 1, sum(words) OVER (PARTITION BY chunk_id ORDER BY pos) FROM par JOIN n USING (chunk_id)),
runs AS (SELECT a.chunk_id, a.k AS a, b.k AS b FROM pre a JOIN pre b ON a.chunk_id = b.chunk_id AND b.k > a.k AND b.s - a.s >= 100),
ahead AS (SELECT chunk_id, a, min(b) AS b FROM runs GROUP BY ALL), behind AS (SELECT chunk_id, b, max(a) AS a FROM runs GROUP BY ALL),
one AS (SELECT par.chunk_id, pos, n, CASE WHEN h.b IS NULL THEN l.a ELSE pos END AS a1, coalesce(h.b, n) AS b1, coalesce(g.a, 0) AS a2, CASE WHEN g.a IS NULL THEN z.b ELSE pos + 1 END AS b2
  FROM par JOIN n USING (chunk_id) LEFT JOIN ahead h ON h.chunk_id = par.chunk_id AND h.a = pos LEFT JOIN behind g ON g.chunk_id = par.chunk_id AND g.b = pos + 1
  JOIN behind l ON l.chunk_id = par.chunk_id AND l.b = n JOIN ahead z ON z.chunk_id = par.chunk_id AND z.a = 0)
SELECT o.chunk_id, o.pos, a1, b1, a2 - CASE WHEN a1 = a2 AND b1 = b2 AND a1 > 0 AND (y.words IS NULL OR x.words < y.words) THEN 1 ELSE 0 END AS a2,
       b2 + CASE WHEN a1 = a2 AND b1 = b2 AND b1 < n AND (x.words IS NULL OR x.words >= y.words) THEN 1 ELSE 0 END AS b2
FROM one o LEFT JOIN par x ON x.chunk_id = o.chunk_id AND x.pos = a1 - 1 LEFT JOIN par y ON y.chunk_id = o.chunk_id AND y.pos = b1""",
    "match_spans": f"WITH {SQL_BASE} SELECT chunk_id, metric, CAST(len(f) AS BIGINT) AS matches, CAST(length(array_to_string(f, '')) AS BIGINT) AS chars FROM ({_spans}) WHERE len(f) > 0",
}
QUERIES = {f.__name__: f for f in (reference_totals, thin_reference, repeated_names, numbered_names, covered_originals, unmatched_edits, edits_of_repeats, drift_paragraphs, span_plan, match_spans, pages_markdown)}
