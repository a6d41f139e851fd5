"""Words and sentences as Spark columns: native expressions, no Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers of all kinds and the underscore, joined by apostrophes or hyphens.
WORD = r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*"
_CLOSERS = r"\"'”’)\]"
#: White space between sentences, but for that after abbreviations.
SENTENCE_BREAK = (
    rf"(?:(?<=[.!?])|(?<=[.!?][{_CLOSERS}]))(?<!\b(?i:approx|fig|sr|jr|st|dr|ms|mrs|mr|vs|i\.e|e\.g)\.)(?!(?<=\b(?:[Cc]h|pp|[Vv]ol|Nos|No)\.)\s+[0-9])"
    rf"\s+(?=[\"“'‘(\[]?[A-Z0-9])"
)
#: The same breaks: what follows is looked at first, and what is before only from the first white space on.
_QUICK_BREAK = (
    rf"\s(?=\s*[\"“'‘(\[]?[A-Z0-9])(?:(?<=[.!?]\s)|(?<=[.!?][{_CLOSERS}]\s))(?<!\b(?i:approx|fig|sr|jr|st|dr|ms|mrs|mr|vs|i\.e|e\.g)\.\s)"
    rf"(?!(?<=\b(?:[Cc]h|pp|[Vv]ol|Nos|No)\.\s)\s*[0-9])\s*(?=[\"“'‘(\[]?[A-Z0-9])"
)


def folded(text: Column) -> Column:
    """Lower case, sharp s as ss, straight apostrophes."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("’"), F.lit("'"))


def tokens(text: Column) -> Column:
    """Folded words of a text, an array."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentences(block: Column) -> Column:
    """Sentences of one block that hold a word, an array."""
    return F.filter(F.split(F.regexp_replace(block, r"^\s+|\s+$", ""), _QUICK_BREAK), lambda s: s.rlike(r"[\p{L}\p{N}_]"))


def plain_blocks(text: Column, separator: str = r"\n[ \t>]*\n") -> Column:
    """Blocks of plain text: runs of lines between blank ones, white space collapsed, those with a word."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b.rlike(r"[\p{L}\p{N}_]"))


def char_trigrams(text: Column) -> Column:
    """Folded three-character windows, an array, in one pass over the text."""
    t = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    t = F.replace(F.translate(t, "‘’“”—–", "''\"\"--"), F.lit("…"), F.lit("..."))
    return F.regexp_extract_all(F.regexp_replace(t, r"\s+", " "), F.lit("(?s)(?=(.{3}))."), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once; named by itself in a lambda, it would be for each element."""
    return F.transform(F.array(value), body)[0]
