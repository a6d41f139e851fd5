"""Sources: folders of text, Markdown, HTML and JSON lines as documents; columns as documents; profiles as tables.

Documents have doc_id, document (what is held out together), source (the file), record (place in the file, null for whole
files) and text, as Markdown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.html import looks_like_html, looks_like_jsonl, to_markdown

# Text fields in order of preference, readable suffixes, folders that never hold a writer's texts.
TEXT_FIELDS = ("text", "body_markdown", "output", "content", "body")
SUFFIXES = ("md", "markdown", "txt", "html", "htm", "jsonl")
SKIPPED = r"/(?:\.[^/]+|node_modules|vendor|venv|__pycache__|_layouts|_includes)/"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without a byte order mark, with line feeds alone."""
    return F.regexp_replace(F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""), "\r\n?", "\n")


def read_folder(spark: SparkSession, path: str, text_field: str | None = None, group_field: str | None = None) -> DataFrame:
    """Documents of all readable files below a path. A file is a task's row; JSON lines are split by Spark's text reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt,html,htm}").load(path)
    kept = files.where(~F.col("path").rlike(SKIPPED)).select(F.col("path").alias("source"), decoded(F.col("content")).alias("text"))
    kept = kept.withColumn("html", F.col("source").rlike(r"(?i)\.html?$") | (F.col("source").rlike(r"(?i)\.txt$") & looks_like_html(F.col("text"))))
    json = kept.where(~F.col("html") & looks_like_jsonl(F.col("text")))
    whole = kept.where(F.col("html") | ~looks_like_jsonl(F.col("text")))
    pages = whole.where("html").withColumn("text", to_markdown(F.col("text"))).unionByName(whole.where("NOT html"))
    whole = pages.select(F.col("source").alias("doc_id"), F.col("source").alias("document"), "source", F.lit(None).cast("long").alias("record"), "text")
    inside = json.select("source", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("source", (F.col("i") + 1).cast("long").alias("record"), "line")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("record"), F.col("value").alias("line")).where(~F.col("source").rlike(SKIPPED))
    return whole.unionByName(records(inside.unionByName(lines), text_field, group_field))


def records(lines: DataFrame, text_field: str | None = None, group_field: str | None = None) -> DataFrame:
    """lines: source, record, line (JSON). Documents; blank lines and lines without a text go.

    The text is the given field, or the first of TEXT_FIELDS that holds a string. An id is the record's own, or its place.
    Records of a group are one document; those without a group are the group (none).
    """
    rows = lines.where("trim(line) <> ''").withColumn("v", F.try_parse_json("line"))
    string = lambda f: F.when(F.schema_of_variant(F.variant_get("v", f"$.{f}", "variant")) == "STRING", F.try_variant_get("v", f"$.{f}", "string"))
    rows = rows.withColumn("text", F.coalesce(*[string(f) for f in ([text_field] if text_field else TEXT_FIELDS)]))
    own = F.nullif(F.try_variant_get("v", "$.id", "string"), F.lit(""))
    rows = rows.withColumn("doc_id", F.concat("source", F.lit(":"), F.coalesce(own, F.col("record").cast("string"))))
    group = F.coalesce(F.nullif(F.trim(F.try_variant_get("v", f"$.{group_field}", "string")), F.lit("")), F.lit("(none)")) if group_field else None
    document = F.col("doc_id") if group is None else F.concat("source", F.lit("#"), group)
    return rows.where("text IS NOT NULL").select("doc_id", document.alias("document"), "source", "record", "text")


def of_table(df: DataFrame, doc_id: str, text: str, document: str | None = None) -> DataFrame:
    """Documents of a table's columns."""
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(document or doc_id).cast("string").alias("document"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("record"), F.col(text).alias("text"))


def group_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(field, values, usable) of columns that could group records: between two values and a third of the rows."""
    wide = df.agg(F.count("*").alias("__rows"), *[F.countDistinct(c).alias(c) for c in names])
    each = wide.select("__rows", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("field", "values"))
    return each.select("field", "values", ((F.col("values") >= 2) & (F.col("values") <= F.col("__rows") / 3)).alias("usable"))


def incremental(texts: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """texts with key (a hash of the text and the measuring code's version) that a table of measurements doesn't have yet."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(version), F.coalesce("text", F.lit(""))), 256))
    return keyed.join(known.select("key"), "key", "left_anti")
