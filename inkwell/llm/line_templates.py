"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens, then by its two leading tokens; tokens with a
digit are variable fields there and everywhere. In a leaf, lines that agree but for one quarter of the remaining tokens
share a template whose variable field is that quarter: each line has four such templates (one, all its tokens, where
fewer than four remain). A template recurs if `least_docs` documents or more carry it; its lines are dropped from every
document but the first that carries it (the smallest id).

Lines of under `least_tokens` tokens, and those without any, have no template and stay; a line of one or two tokens is
its own template. Null texts stay null, with no lines; an empty text is one empty line. Null ids come first. Rows that
repeat both id and text are one document here and keep or lose the same lines. A very long text is a row like any other.
Most templates are those of one line, so rows are counted by template first, and a bitmap of bounded size holds the
templates of enough rows: only lines that it may hold are dealt out with their ids. A full bitmap holds back none.
Columns of docs with names used here don't meet them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize

DEPTH = 2
PARTS = 4
#: The bitmap of templates has 2 to this power words of 64 bits (2 MB; 10 MiB as a broadcast table, if all are in use).
WORD_BITS = 18


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _tokens(text: Column) -> Column:
    """The tokens of each line of a text, masked: an array of arrays. White space and digits are looked for once a text."""
    spaced = F.when(text.rlike("[\t\\x0B\f\r]"), F.translate(text, "\t\v\f\r", "    ")).otherwise(text)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(spaced)
    return F.transform(_lines(masked), lambda line: F.array_remove(F.split(line, " "), ""))


def templates(lines: DataFrame, least_tokens: int) -> DataFrame:
    """lines: tokens and others. Adds key, a hash for each template of the line; lines without one go."""
    rows = lines.withColumn("n", F.size("tokens")).where(F.col("n") >= max(1, least_tokens))
    rest = F.col("n") - DEPTH
    at = [F.floor(rest * j / PARTS).cast("int") for j in range(PARTS + 1)]
    part = [F.xxhash64(F.slice("tokens", DEPTH + 1 + at[j], at[j + 1] - at[j])) for j in range(PARTS)]
    rows = rows.withColumn("head", F.xxhash64("n", F.slice("tokens", 1, DEPTH))).withColumns({f"part{j}": F.when(rest >= PARTS, part[j]) for j in range(PARTS)})
    but_one = F.array(*[F.xxhash64("head", F.lit(j), *[f"part{k}" for k in range(PARTS) if k != j]) for j in range(PARTS)])
    keys = F.when(rest >= PARTS, but_one).otherwise(F.array(F.xxhash64("head", F.lit(-1), "tokens")))
    return rows.select(*[c for c in lines.columns if c != "tokens"], F.explode(keys).alias("key"))


def _frequent(each: DataFrame, least: int) -> DataFrame:
    """The rows of each whose key is in `least` rows or more, and some others: those that share a bit with such a key."""
    word, bit = F.shiftrightunsigned("key", 64 - WORD_BITS).alias("word"), F.col("key").bitwiseAND(63).cast("int")
    often = each.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    words = often.select(word, bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return each.withColumn("word", word).join(F.broadcast(words), "word").where(F.getbit("bits", bit) == 1).select(each.columns)


def dropped_lines(docs: DataFrame, doc_id: str, text: str, least_docs: int, least_tokens: int) -> DataFrame:
    """Rows (id, mark, dropped): the documents that lose lines (mark: hash of the text), and those lines' ascending numbers."""
    lines = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(_tokens(F.col(text))).alias("i", "tokens"))
    every = materialize(templates(lines, least_tokens))
    each = materialize(_frequent(every, least_docs))
    discard(every)
    carried = each.select("key", "id", "mark").distinct()
    recurring = materialize(carried.groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct("id", "mark")).alias("first")).where(F.col("docs") >= least_docs))
    later = each.join(recurring, "key").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))))
    drops = materialize(later.groupBy("id", "mark").agg(F.array_sort(F.collect_set("i")).alias("dropped")))
    discard(each, recurring)
    return drops


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = 5, least_tokens: int = 1, counts: tuple[str, str] = ("lines_before", "lines_dropped")) -> DataFrame:
    """The documents, with recurring lines gone from text, and the columns of `counts` added; columns of these names give way."""
    drops = dropped_lines(docs, doc_id, text, least_docs, least_tokens).alias("__drops")
    found = docs.alias("__docs").join(drops, F.col(f"__docs.{doc_id}").eqNullSafe(F.col("__drops.id")) & (F.xxhash64(f"__docs.{text}") == F.col("__drops.mark")), "left")
    body, gone = F.col(f"__docs.{text}"), F.coalesce("__drops.dropped", F.array().cast("array<int>"))
    lines = _lines(body)
    # Runs of kept lines between dropped ones.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    kept = F.when(F.col("__drops.dropped").isNull(), body).otherwise(F.array_join(F.flatten(runs), "\n"))
    before = F.when(body.isNull(), 0).otherwise(F.size(lines))
    own = [kept.alias(c) if c == text else F.col(f"__docs.{c}") for c in docs.columns if c not in counts]
    return found.select(*own, before.alias(counts[0]), F.size(gone).alias(counts[1]))
