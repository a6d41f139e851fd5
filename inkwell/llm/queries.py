"""Queries over the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, embed_dedup, langid, line_templates, mixing, quality, secret_scan, simhash, suffix_dedup, token_counts
from inkwell.llm.common import table


def _remainder(doc_id: str, by: int):
    return F.crc32(F.col(doc_id).cast("string")) % by


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.9."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that also start elsewhere."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: A byte-level BPE vocabulary as ranks, read on the driver; a path of the environment comes first.
TOKENIZER = os.environ.get("INKWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents as flat token files; the tokens of each, found by separators alone."""
    blocks, order = token_counts.flat_files(table(spark, sf_dir, "documents"), token_counts.read_ranks(tokenizer), end=50256)
    return order.join(token_counts.count(blocks, 50256), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents, edited copies too: a row for each document and item."""
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("seeds")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles of all documents, linked at 4 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, bits=4).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose templates recur in 5 documents or more."""
    got = line_templates.line_dedup(table(spark, sf_dir, "documents"), least_docs=5, least_tokens=1)
    return got.select("doc_id", F.col("lines_before").cast("long").alias("n_lines"), F.col("lines_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, text, i, list_filter(string_split(regexp_replace(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda x: x <> '') AS t FROM l),
n AS (SELECT *, len(t) AS n, len(t) - 2 AS r FROM m WHERE len(t) >= 1),
k AS (
  SELECT doc_id, text, i, n || '/' || j || '/' || array_to_string(t[1:2], ' ') || '/' ||
         array_to_string(list_transform(range(4), lambda p: CASE WHEN p = j THEN '' ELSE array_to_string(t[3 + r * p // 4 : 2 + r * (p + 1) // 4], ' ') END), '/') AS key
  FROM (SELECT *, unnest(range(4)) AS j FROM n WHERE r >= 4)
  UNION ALL SELECT doc_id, text, i, n || '/-1/' || array_to_string(t, ' ') FROM n WHERE r < 4),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT DISTINCT k.doc_id, i FROM k JOIN f USING (key) WHERE k.doc_id <> first),
p AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5
FROM documents d LEFT JOIN p USING (doc_id)
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights 5, 2, 1 by source, 3 epochs at most."""
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS tie,
         greatest(0.05::DOUBLE, 1 - 4 * (1 - CAST(length(translate(coalesce(text, ''), '*$%&#|!<>{}[]\^~', '')) AS DOUBLE) / greatest(length(coalesce(text, '')), 1))) AS good
  FROM documents),
k AS (SELECT *, -ln((CAST(CAST('0x' || substr(tie, 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710657.0::DOUBLE) / good AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
             CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM k GROUP BY source),
f AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM f WHERE level * w <= cap) * w, cap)) AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, greatest(0, g.target - g.epochs * g.source_size) AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS INTEGER) AS epochs
FROM (SELECT *, epochs + CASE WHEN rest > 0 AND before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END AS n FROM p)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of a fifth of ids are held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), quality.scored(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of ids is held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder("doc_id", 3) != 1), "text", "lang")
    got = docs.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), langid.predicted(model, F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; sources are owners."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_repeated_bytes, op3_token_counts, op4_decontaminate, op5_simhash, op6_line_dedup, op7_mix_sources, op8_quality, op9_language, op10_secrets)}
SQL = {"op6_line_dedup": OP6_SQL, "op7_mix_sources": OP7_SQL}
