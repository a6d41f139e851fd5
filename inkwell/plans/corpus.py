"""Queries over corpus preparation and pattern distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import corpus, measure as m, patterns
from inkwell.plans.base import SQL_BASE, _W, chunks, table
from inkwell.plans.measure import _prep, _rounded
from inkwell.sources.tables import heavy


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose word sequence no document before has."""
    return corpus.drop_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id")


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped duplicates and the copy kept."""
    got = corpus.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return got.where("first.doc_id <> doc_id").select(F.col("doc_id").alias("dropped_id"), F.col("first.doc_id").alias("kept_id"))


def window_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into windows of about 500 words: words of each."""
    return corpus.windows(_prep(spark, sf_dir), 500).select("chunk_id", "window", "n")


def pool_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation and role joined to windows of about 120 words."""
    return corpus.pool(table(spark, sf_dir, "conversations"), ("conv_id", "role"), "turn", "text", 120).select("conv_id", "role", "window", "n", "texts")


def pooling_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turns are short enough to pool by default."""
    turns = table(spark, sf_dir, "conversations").select("text")
    return corpus.pools_by_default(m.prepared(turns).where("n > 0"))


def piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th sentence of the writers, k to keep about 30000 words."""
    s = m.each(_prep(spark, sf_dir).where("role = 'writer'"), ("chunk_id",), F.posexplode_outer("lens").alias("pos", "n"), "pos")
    return corpus.every_kth(s, ["chunk_id", "pos"], "n").select("chunk_id", F.col("pos").cast("long").alias("pos"), "n", "k")


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order as eight stand-in documents or fewer."""
    return corpus.stand_ins(chunks(spark, sf_dir).select("document", "chunk_id"), "document", "chunk_id")


def group_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are conversations long enough to be documents?"""
    return corpus.group_quality(table(spark, sf_dir, "conversations"), "conv_id")


def group_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that could group records: distinct values, and whether they are between 2 and a third of the rows."""
    t = table(spark, sf_dir, "conversations")
    wide = t.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(c) for c in ("conv_id", "turn", "role")])
    each = wide.select("rows", F.explode(F.create_map(*[x for c in ("conv_id", "turn", "role") for x in (F.lit(c), F.col(c))])).alias("field", "values"))
    return each.select("field", "values", ((F.col("values") >= 2) & (F.col("values") <= F.col("rows") / 3)).alias("usable"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.masked_bigrams(m.token_rows(_prep(spark, sf_dir)))


def masked_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of function word transitions in each chunk."""
    return patterns.counted(_patterns(spark, sf_dir), ["chunk_id"])


def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of character trigrams over all chunks."""
    return patterns.counted(m.trigrams(_prep(spark, sf_dir)), [])


def topk_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 most frequent trigrams and the rest, as shares."""
    return _rounded(patterns.top_k(char_trigrams(spark, sf_dir), []))


def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each draft's transitions from the writers'."""
    prep = _prep(spark, sf_dir).select("chunk_id", "role", "tok")
    rows = m.masked_bigrams(m.token_rows(prep)).join(prep.select("chunk_id", "role"), "chunk_id")
    reference = patterns.top_k(patterns.counted(rows.where("role = 'writer'"), []), [], 300)
    sample = patterns.top_k(patterns.counted(rows.where("role = 'draft'"), ["chunk_id"]), ["chunk_id"], 1 << 30)
    return _rounded(patterns.divergence(patterns.collapsed(sample, reference, ["chunk_id"]), reference, ["chunk_id"]))


def ngram13_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each document changes of its 13-word sequences to the document five ids on."""
    d, n = chunks(spark, sf_dir).select("chunk_id", "text"), heavy(spark)
    old, new = d.select(F.col("chunk_id").alias("pair"), F.col("text").alias("old")), d.select((F.col("chunk_id") - 5).alias("pair"), F.col("text").alias("new"))
    pairs = old.where("pair IS NOT NULL").repartition(n, "pair").join(new.where("pair IS NOT NULL").repartition(n, "pair"), "pair")
    return _rounded(corpus.ngram_changed(pairs))


def pair_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents paired with even ones: by whole text where unique, then by source and length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("whole"), F.concat("source", F.lit("/"), F.length("text")).alias("stem"))
    return corpus.paired(docs.where("id % 2 = 1"), docs.where("id % 2 = 0"), ["whole", "stem"])


_J = r"""j AS (SELECT chunk_id, role, tok, lead(tok) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt FROM (SELECT t.chunk_id, b.role, t.pos, CASE WHEN tok IN ({fw}) THEN tok ELSE '·' END AS tok FROM toks t JOIN base b USING (chunk_id))),
g AS (SELECT chunk_id, role, tok || ' ' || nxt AS pattern FROM j WHERE nxt IS NOT NULL AND NOT (tok = '·' AND nxt = '·'))"""
from inkwell.functions.lexicon import FUNCTION_WORDS  # noqa: E402

_J = _J.replace("{fw}", ", ".join(f"'{w}'" for w in FUNCTION_WORDS))
_G = r"""c AS (SELECT regexp_replace(replace(translate(replace(lower(t), 'ß', 'ss'), '‘’“”—–', '''''""--'), '…', '...'), '\s+', ' ', 'g') AS t FROM base), tri AS (SELECT substr(t, CAST(i AS BIGINT), 3) AS pattern, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM c WHERE length(t) >= 3) GROUP BY ALL)"""


def _pack_sql(items: str, words: int) -> str:
    """Recursive greedy packing of items(k, pos, n), pos from 0."""
    return f"""WITH RECURSIVE {items},
p(k, pos, n, w, c, open, g) AS (
  SELECT k, pos, n, CASE WHEN n >= {words} THEN 1 ELSE 0 END, CASE WHEN n >= {words} THEN 0 ELSE n END, n < {words}, 0 FROM items WHERE pos = 0
  UNION ALL
  SELECT k, pos, n, CASE WHEN full_ THEN v + 1 ELSE v END, CASE WHEN full_ THEN 0 ELSE d END, NOT full_, v
  FROM (SELECT *, d >= {words} AS full_ FROM (SELECT i.k, i.pos, i.n, CASE WHEN p.open AND p.c * 2 >= {words} AND p.c + i.n > {words} * 1.5 THEN p.w + 1 ELSE p.w END AS v,
        CASE WHEN p.open AND p.c * 2 >= {words} AND p.c + i.n > {words} * 1.5 THEN 0 ELSE p.c END + i.n AS d FROM p JOIN items i ON i.k = p.k AND i.pos = p.pos + 1))),
last AS (SELECT k, arg_max(w, pos) AS w, arg_max(c, pos) AS c, arg_max(open, pos) AS open FROM p GROUP BY k),
packed AS (SELECT p.k, p.pos, p.n, CASE WHEN l.open AND l.w > 0 AND l.c * 2 < {words} THEN least(p.g, l.w - 1) ELSE p.g END AS g FROM p JOIN last l USING (k))"""


_key = rf"CASE WHEN len(regexp_extract_all(text, '{_W}')) >= 20 THEN array_to_string(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '{_W}'), ' ') END"
SQL = {
    "dedup_documents": f"WITH k AS (SELECT doc_id, {_key} AS k FROM documents) SELECT doc_id FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) AS first FROM k) WHERE k IS NULL OR doc_id = first",
    "duplicate_pairs": f"WITH k AS (SELECT doc_id, {_key} AS k FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM k WHERE k IS NOT NULL) SELECT doc_id AS dropped_id, first AS kept_id FROM f WHERE doc_id <> first",
    "window_pack": _pack_sql(f"{SQL_BASE}, items AS MATERIALIZED (SELECT s.chunk_id AS k, s.pos, s.n FROM sents s JOIN words w USING (chunk_id) WHERE w.n > 750 UNION ALL SELECT chunk_id, 0, CAST(n AS INTEGER) FROM words WHERE n <= 750 AND n > 0)", 500) + " SELECT k AS chunk_id, CAST(g AS INTEGER) AS \"window\", CAST(sum(n) AS BIGINT) AS n FROM packed GROUP BY k, g",
    "pool_conversations": _pack_sql(rf"r AS (SELECT conv_id, role, turn, len(regexp_extract_all(text, '{_W}')) AS n FROM conversations), items AS MATERIALIZED (SELECT conv_id || '/' || role AS k, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos, n FROM r WHERE n > 0)", 120) + " SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS conv_id, split_part(k, '/', 2) AS role, CAST(g AS INTEGER) AS \"window\", CAST(sum(n) AS BIGINT) AS n, count(*) AS texts FROM packed GROUP BY k, g",
    "pooling_rule": rf"SELECT median(n) AS median_words, median(n) < 125 AS pool FROM (SELECT len(regexp_extract_all(text, '{_W}')) AS n FROM conversations) WHERE n > 0",
    "piece_sampling": f"WITH {SQL_BASE}, s AS (SELECT s.chunk_id, s.pos, s.n, row_number() OVER (ORDER BY s.chunk_id, s.pos) - 1 AS r FROM sents s JOIN base USING (chunk_id) WHERE role = 'writer'), k AS (SELECT CAST(greatest(1, ceil(sum(n) / 30000.0)) AS BIGINT) AS k FROM s) SELECT chunk_id, pos, n, k FROM s, k WHERE r % k = 0",
    "stand_ins": "WITH b AS (SELECT source AS document, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT document, chunk_id, CAST((SELECT count(*) FROM range(1, 9) r(i) WHERE i <= least(8, n) AND round_even(i * n / CAST(least(8, n) AS DOUBLE), 0) <= place) AS INTEGER) AS stand_in FROM b",
    "group_quality": rf"WITH g AS (SELECT conv_id, sum(len(regexp_extract_all(text, '{_W}'))) AS n, count(*) AS c FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS records, count(*) AS groups, median(n) AS median_group_words, (SELECT count(*) FROM conversations WHERE conv_id IS NULL) AS without_group FROM g",
    "group_fields": "WITH c AS (SELECT count(*) AS r, count(DISTINCT conv_id) AS a, count(DISTINCT turn) AS b, count(DISTINCT role) AS c FROM conversations), e AS (SELECT r, 'conv_id' AS field, a AS v FROM c UNION ALL SELECT r, 'turn', b FROM c UNION ALL SELECT r, 'role', c FROM c) SELECT field, v AS \"values\", v >= 2 AND v <= r / 3.0 AS usable FROM e",
    "masked_bigrams": f"WITH {SQL_BASE}, {_J} SELECT chunk_id, pattern, count(*) AS n FROM g GROUP BY ALL",
    "char_trigrams": f"WITH {SQL_BASE}, {_G} SELECT pattern, n FROM tri",
    "topk_other": f"WITH {SQL_BASE}, {_G}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS r, sum(n) OVER () AS total FROM tri) SELECT CASE WHEN r <= 300 THEN pattern ELSE '<other>' END AS pattern, round(sum(n) / CAST(any_value(total) AS DOUBLE), 6) AS share FROM r GROUP BY 1",
    "js_divergence": f"WITH {SQL_BASE}, {_J}, rc AS (SELECT pattern, count(*) AS n FROM g WHERE role = 'writer' GROUP BY 1), rr AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS r, sum(n) OVER () AS t FROM rc), q AS (SELECT CASE WHEN r <= 300 THEN pattern ELSE '<other>' END AS pattern, sum(n) / CAST(any_value(t) AS DOUBLE) AS q FROM rr GROUP BY 1), s AS (SELECT chunk_id, CASE WHEN pattern IN (SELECT pattern FROM q) THEN pattern ELSE '<other>' END AS pattern, count(*) AS n FROM g WHERE role = 'draft' GROUP BY ALL), p AS (SELECT chunk_id, pattern, n / CAST(sum(n) OVER (PARTITION BY chunk_id) AS DOUBLE) AS p FROM s), x AS (SELECT c.chunk_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT chunk_id, pattern FROM (SELECT DISTINCT chunk_id FROM p) CROSS JOIN (SELECT pattern FROM q UNION SELECT pattern FROM p)) c LEFT JOIN p USING (chunk_id, pattern) LEFT JOIN q USING (pattern)) SELECT chunk_id, round(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 6) AS divergence FROM x GROUP BY chunk_id",
    "ngram13_changed": rf"WITH {SQL_BASE}, w AS (SELECT doc_id, regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '{_W}') AS w FROM documents), gr AS (SELECT doc_id, array_to_string(w[CAST(i AS BIGINT) : CAST(i + 12 AS BIGINT)], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)), p AS (SELECT a.doc_id AS pair FROM w a JOIN w b ON b.doc_id = a.doc_id + 5), c AS (SELECT gr.doc_id AS pair, count(*) AS grams, count(*) FILTER (b.g IS NULL) / CAST(count(*) AS DOUBLE) AS changed FROM gr LEFT JOIN (SELECT DISTINCT doc_id - 5 AS doc_id, g FROM gr) b ON b.doc_id = gr.doc_id AND b.g = gr.g GROUP BY 1) SELECT pair, grams, round(changed, 6) AS changed FROM p LEFT JOIN c USING (pair)",
    "pair_edits": "WITH d AS (SELECT doc_id AS id, md5(text) AS whole, source || '/' || length(text) AS stem FROM documents), o AS (SELECT * FROM d WHERE id % 2 = 0), a AS (SELECT whole, min(id) AS x FROM o GROUP BY 1 HAVING count(*) = 1), b AS (SELECT stem, min(id) AS y FROM o GROUP BY 1 HAVING count(*) = 1) SELECT id, coalesce(x, y) AS original, CASE WHEN x IS NOT NULL THEN 'whole' WHEN y IS NOT NULL THEN 'stem' END AS \"by\" FROM d LEFT JOIN a USING (whole) LEFT JOIN b USING (stem) WHERE id % 2 = 1",
}
QUERIES = {f.__name__: f for f in (dedup_documents, duplicate_pairs, window_pack, pool_conversations, pooling_rule, piece_sampling, stand_ins, group_quality, group_fields, masked_bigrams, char_trigrams, topk_other, js_divergence, ngram13_changed, pair_edits)}
