"""Syntax metrics from an annotations table (chunk_id, sent, i, head, pos, tag, dep, lower, is_alpha): any parser can feed it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dependency labels and endings as the usual English scheme names them.
CLAUSES = ("acl", "advcl", "ccomp", "csubj", "csubjpass", "relcl", "xcomp")
PASSIVES = ("auxpass", "csubjpass", "nsubjpass")
NOMINAL = r"(?:tion|sion|ment|ness|ity|ance|ence)$"
OPENERS = {"pronoun": ("PRON",), "determiner": ("DET",), "adverb_or_preposition": ("ADV", "ADP"), "subordinator": ("SCONJ",), "conjunction": ("CCONJ",), "noun": ("NOUN", "PROPN"), "verb": ("VERB", "AUX")}
LEAST_SENTENCE = 3


def singular(word: Column) -> Column:
    """Plural endings folded: ies to y, s away but for ss, us and is."""
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?<![sui])s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def is_nominalization(word: Column) -> Column:
    """Six letters or more, with an ending that makes nouns of verbs and adjectives."""
    one = singular(F.lower(word))
    return (F.length(one) >= 6) & one.rlike(NOMINAL)


def heights(heads: Column) -> Column:
    """Height of a sentence's tree: places of heads in the sentence, from 0; a root is its own head. Cycles end."""

    @F.arrow_udf("int")
    def height(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            own = row.as_py() or []
            deep: dict[int, int] = {}
            for k in range(len(own)):
                path = []
                while k not in deep and k not in path:
                    path.append(k)
                    k = own[k] if 0 <= own[k] < len(own) else k
                base = deep.get(k, 0)
                for n, node in enumerate(reversed(path)):
                    deep[node] = base + n + (k in deep)
            out.append(max(deep.values(), default=0))
        return pa.array(out, pa.int32())

    return height(heads)


def metrics(annotations: DataFrame) -> DataFrame:
    """A row for each chunk with the 15 syntax metrics; sentences of under three words have no part in depth."""
    alpha = F.col("is_alpha")
    some = lambda *p: F.col("pos").isin(*p)
    counted = lambda test: F.count_if(alpha & test)
    first = F.min_by(F.when(alpha, F.col("pos")), F.when(alpha, F.col("i")))
    sentence = annotations.groupBy("chunk_id", "sent").agg(
        counted(F.lit(True)).alias("n"), F.count_if(F.col("dep").isin(*CLAUSES)).alias("clauses"), F.max(F.col("dep").isin(*PASSIVES)).alias("passive"), counted(some("NOUN", "PROPN")).alias("nouns"), counted(some("VERB")).alias("verbs"),
        counted(some("ADJ")).alias("adjectives"), counted(some("ADV")).alias("adverbs"), F.count_if(F.col("tag") == "MD").alias("modals"), counted(is_nominalization(F.col("lower"))).alias("nominalizations"), first.alias("opens"),
        F.array_sort(F.collect_list(F.struct("i", "head"))).alias("tree"),
    ).where("n > 0")
    base = F.transform("tree", lambda x: (x["head"] - F.element_at("tree", 1)["i"]).cast("int"))
    sentence = sentence.withColumn("depth", F.when(F.col("n") >= LEAST_SENTENCE, heights(base)))
    per_1k = lambda c: F.try_divide(1000.0 * F.sum(c), F.sum("n"))
    share = lambda test: 100.0 * F.count_if(F.coalesce(test, F.lit(False))) / F.count("*")
    return sentence.groupBy("chunk_id").agg(
        F.avg("depth").alias("parse_depth_mean"), F.avg("clauses").alias("clauses_per_sentence"), share(F.col("passive")).alias("passive_sentences_pct"), F.try_divide(F.sum("nouns"), F.sum("verbs")).alias("noun_verb_ratio"),
        *[per_1k(c).alias(f"{c}_per_1k") for c in ("adjectives", "adverbs", "modals", "nominalizations")], *[share(F.col("opens").isin(*p)).alias(f"opens_{k}_pct") for k, p in OPENERS.items()],
    )


def tag_trigrams(annotations: DataFrame) -> DataFrame:
    """(chunk_id, pattern): part-of-speech trigrams within sentences."""
    run = Window.partitionBy("chunk_id", "sent").orderBy("i")
    rows = annotations.withColumns({"b": F.lead("pos", 1).over(run), "c": F.lead("pos", 2).over(run)}).where("c IS NOT NULL")
    return rows.select("chunk_id", F.concat_ws(" ", "pos", "b", "c").alias("pattern"))
