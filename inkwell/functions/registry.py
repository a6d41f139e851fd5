"""Every style metric once: area, name, unit, the count it is a share of, and whether it needs a parser."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from inkwell.functions.lexicon import FUNCTION_WORDS


class Metric(NamedTuple):
    grp: str
    metric: str
    unit: str
    share_of: str | None
    syntax: bool = False


#: Areas that are reported but not scored.
UNSCORED = ("size", "register", "social", "rhetoric")


def _rows(grp: str, unit: str, share_of: str | None, names: str, syntax: bool = False) -> list[Metric]:
    return [Metric(grp, n + {"/1k": "_per_1k", "%": "_pct"}.get(unit, ""), unit, share_of, syntax) for n in names.split()]


METRICS: tuple[Metric, ...] = (
    *_rows("size", "", None, "words sentences paragraphs apostrophes"),
    *_rows("sentence_shape", "words", None, "sentence_words_mean sentence_words_median sentence_words_sd paragraph_words_mean"),
    *_rows("sentence_shape", "", None, "paragraph_sentences_mean"),
    *_rows("sentence_shape", "%", "sentences", "short_sentences long_sentences"),
    *_rows("sentence_shape", "%", "paragraphs", "one_sentence_paragraphs"),
    *_rows("rhythm", "", None, "sentence_length_cv sentence_length_change_mean"),
    *_rows("vocabulary", "", None, "word_chars_mean mattr_100 mtld hapax_share_100"),
    *_rows("vocabulary", "%", "words", "long_words"),
    *_rows("punctuation", "/1k", "words", "commas semicolons colons em_dashes parentheses questions exclamations ellipses quotations"),
    *_rows("voice", "/1k", "words", "contractions first_singular first_plural second_person negations hedges boosters llm_markers not_just_but corrective_contrasts parallel_triads"),
    *_rows("voice", "%", "sentences", "and_but_so_openers transition_openers"),
    *_rows("markdown", "/1k", "words", "headings list_items links bold code_spans"),
    *_rows("syntax", "", None, "parse_depth_mean clauses_per_sentence noun_verb_ratio", True),
    *_rows("syntax", "%", "sentences", "passive_sentences", True),
    *_rows("syntax", "/1k", "words", "adjectives adverbs modals nominalizations", True),
    *_rows("sentence_openers", "%", "sentences", "opens_pronoun opens_determiner opens_adverb_or_preposition opens_subordinator opens_conjunction opens_noun opens_verb", True),
    *_rows("function_words", "/1k", "words", " ".join(f"fw_{w}" for w in FUNCTION_WORDS)),
    *_rows("register", "/1k", None, "edited_register"),
    *_rows("social", "/1k", "words", "symbol_bullets emoji"),
    *_rows("rhetoric", "/1k", "words", "comma_series semicolon_balances colon_reveals"),
)


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table of some 160 rows."""
    return spark.createDataFrame([(m.grp, m.metric, m.unit, m.share_of, m.syntax, m.grp not in UNSCORED) for m in METRICS], "grp string, metric string, unit string, share_of string, syntax boolean, scored boolean")
