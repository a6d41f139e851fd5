"""Style metrics of chunks: prepared token and sentence columns, per-area expressions, wide and long tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions.registry import METRICS, UNSCORED
from inkwell.functions.tokens import WORD, char_trigrams, folded, let, plain_blocks, sentences
from inkwell.operators.vocabulary import vocabulary
from inkwell.sources.scratch import materialize

SHORT, LONG, LONG_WORD = 8, 30, 7
#: Prose columns of a chunk: what the Markdown reduction gives, or plain text.
PROSE = "struct<blocks:array<string>,paragraphs:array<string>,headings:int,list_items:int,links:int,bold:int,code_spans:int>"


def plain_prose(text: Column, separator: str = r"\n[ \t>]*\n") -> Column:
    """The prose struct of plain text: blocks are paragraphs, no markup."""
    blocks = plain_blocks(text, separator)
    return F.struct(blocks.alias("blocks"), blocks.alias("paragraphs"), *[F.lit(0).alias(c) for c in ("headings", "list_items", "links", "bold", "code_spans")])


def prepared(chunks: DataFrame, text: str = "text", prose: Column | None = None) -> DataFrame:
    """chunks with prose, t (prose text), plain (apostrophes straight), folded, tok (folded words), sents, lens (words of each) and
    par_sents (sentences of each paragraph)."""
    df = chunks.withColumn("prose", plain_prose(F.col(text)) if prose is None else prose)
    df = df.withColumn("t", F.array_join("prose.blocks", "\n\n"))
    df = df.withColumns({"plain": F.replace("t", F.lit("’"), F.lit("'")), "folded": folded(F.col("t")), "by_block": F.transform("prose.blocks", sentences)})
    by_paragraph = F.col("by_block") if prose is None else F.transform("prose.paragraphs", sentences)  # plain blocks are paragraphs
    df = df.withColumns({"sents": F.flatten("by_block"), "par_sents": F.transform(by_paragraph, F.size)}).drop("by_block")
    df = df.withColumns({"tok": F.regexp_extract_all("folded", F.lit(WORD), F.lit(0)), "lens": F.transform("sents", lambda s: F.regexp_count(s, F.lit(WORD)))})
    return df.withColumn("n", F.size("tok"))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.try_element_at(s, k.cast("int")).cast("double")
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def _pstdev(counts: Column) -> Column:
    """Of whole numbers, so that sums of squares are exact."""
    n = F.size(counts)
    total, squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(n > 0, F.sqrt(n * squares - total * total) / n)


def _share(values: Column, test) -> Column:
    return F.when(F.size(values) > 0, 100.0 * F.size(F.filter(values, test)) / F.size(values))


def _rate(count: Column) -> Column:
    return F.when(F.col("n") > 0, count * (1000.0 / F.col("n")))


def _holds(texts: tuple[str, ...]) -> Column:
    """Whether the folded text of a chunk holds one of some texts."""
    return reduce(lambda a, b: a | b, [F.col("folded").contains(x) for x in texts])


def _matches(column: str, pattern: str) -> Column:
    """Matches of a pattern in t or plain (of prepared chunks), or another column."""
    quick, hints = lx.QUICK.get(pattern, (pattern, ()))
    count = F.regexp_count(column, F.lit(quick))
    return F.when(_holds(hints), count).otherwise(0) if hints else count


def _listed(words: tuple[str, ...], or_ends: tuple[str, ...] = (), among: str = "tok") -> Column:
    def test(x: Column) -> Column:
        found = x.isin(*words)
        for end in or_ends:
            found = found | x.endswith(end)
        return found

    return F.size(F.filter(among, test))


_VOICE = {"contractions": (lx.S_CONTRACTIONS, lx.CONTRACTION_ENDS), "first_singular": (lx.FIRST_SINGULAR, ()), "first_plural": (lx.FIRST_PLURAL, ()), "second_person": (lx.SECOND_PERSON, ()), "negations": (lx.NEGATIONS, ("n't",))}


def _voiced() -> Column:
    """The words that the voice lists may count: theirs, and those with an apostrophe, as all their endings have one."""
    listed = sorted({w for words, _ in _VOICE.values() for w in words if "'" not in w})
    return F.filter("tok", lambda x: x.isin(*listed) | x.contains("'"))


def _area_columns(among: str = "tok") -> dict[str, dict[str, Column]]:
    lens, paragraphs = F.col("lens"), F.col("prose.paragraphs")
    per = lambda fn: F.transform(paragraphs, fn)
    long_single = (F.col("n") >= 300) & (F.size(paragraphs) == 1)
    structure = lambda c: F.when(~long_single, c)
    change = F.when(F.size(lens) > 1, _mean(F.zip_with(F.slice(lens, 1, F.greatest(F.size(lens) - 1, F.lit(0))), F.slice(lens, 2, F.greatest(F.size(lens) - 1, F.lit(0))), lambda a, b: F.abs(b - a))))
    mean = _mean(lens)
    return {
        "size": {"words": F.col("n").cast("double"), "sentences": F.size(lens).cast("double"), "paragraphs": F.size(paragraphs).cast("double"), "apostrophes": _matches("t", "['‘’]").cast("double")},
        "sentence_shape": {
            "sentence_words_mean": mean, "sentence_words_median": _median(lens), "sentence_words_sd": _pstdev(lens),
            "short_sentences_pct": _share(lens, lambda x: x <= SHORT), "long_sentences_pct": _share(lens, lambda x: x >= LONG),
            "paragraph_sentences_mean": structure(_mean(F.col("par_sents"))), "paragraph_words_mean": structure(_mean(per(lambda p: F.regexp_count(p, F.lit(WORD))))),
            "one_sentence_paragraphs_pct": structure(_share(F.col("par_sents"), lambda x: x == 1)),
        },
        "rhythm": {"sentence_length_cv": F.when(mean > 0, _pstdev(lens) / mean), "sentence_length_change_mean": change},
        "vocabulary": {"word_chars_mean": F.when(F.col("n") > 0, F.length(F.array_join("tok", "")).cast("double") / F.col("n")), "long_words_pct": _share(F.col("tok"), lambda x: F.length(x) >= LONG_WORD), "mtld": vocabulary(F.col("tok"), ("mtld",))["mtld"]},
        "punctuation": {
            f"{name}_per_1k": _rate(count) for name, count in {
                **{k: _matches("t", v) for k, v in {"commas": ",", "semicolons": ";", "colons": ":", "em_dashes": lx.EM_DASHES, "parentheses": r"\(", "questions": r"\?", "exclamations": "!", "ellipses": lx.ELLIPSES}.items()},
                "quotations": _matches("t", "“") + F.floor(_matches("t", '"') / 2),
            }.items()
        },
        "voice": {
            **{f"{k}_per_1k": _rate(_listed(*v, among)) for k, v in _VOICE.items()},
            **{f"{k}_per_1k": _rate(_matches("plain", v)) for k, v in {"hedges": lx.HEDGES, "boosters": lx.BOOSTERS, "llm_markers": lx.LLM_MARKERS, "not_just_but": lx.NOT_JUST_BUT, "corrective_contrasts": lx.CORRECTIVE_CONTRASTS}.items()},
            "parallel_triads_per_1k": _rate(_matches("t", lx.PARALLEL_TRIADS)),
            "and_but_so_openers_pct": _share(F.col("sents"), lambda s: s.rlike(lx.AND_BUT_SO_OPENERS)), "transition_openers_pct": _share(F.col("sents"), lambda s: s.rlike(lx.TRANSITION_OPENERS)),
        },
        "markdown": {f"{c}_per_1k": _rate(F.col(f"prose.{c}")) for c in ("headings", "list_items", "links", "bold", "code_spans")},
        "social": {"symbol_bullets_per_1k": _rate(_matches("raw", lx.SYMBOL_BULLETS)), "emoji_per_1k": _rate(_matches("raw", lx.EMOJI))},
        "rhetoric": {f"{k}_per_1k": _rate(_matches("t", v)) for k, v in {"comma_series": lx.COMMA_SERIES, "semicolon_balances": lx.SEMICOLON_BALANCES, "colon_reveals": lx.COLON_REVEALS}.items()},
    }


def each(rows: DataFrame, keep: tuple[str, ...], outer: Column, name: str) -> DataFrame:
    """Elements of an array by an outer generator, `name` one of its columns that no element has null.

    Under a generator that isn't outer Spark infers a filter on the array's size, pushes it down below joins and filters on
    other columns, and computes the array there for all rows, and once more for those kept.
    """
    return rows.select(*keep, outer).where(F.col(name).isNotNull())


def token_rows(prep: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pos, tok), positions from 0."""
    return each(prep, (key,), F.posexplode_outer("tok").alias("pos", "tok"), "pos")


def token_totals(prep: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, words, types, chars) of chunks with a word; rows of one key are one chunk.

    A row is counted where it is. Only the words of keys that several rows have are dealt out, once it is known that there are any.
    """
    long = lambda c: c.cast("long")
    held = materialize(prep.where("n > 0").select(key, long(F.col("n")).alias("words"), long(F.size(F.array_distinct("tok"))).alias("types"), long(F.length(F.array_join("tok", ""))).alias("chars")))
    once = held.groupBy(key).agg(F.count("*").alias("__rows"), *[F.min(c).alias(c) for c in ("words", "types", "chars")])
    single = once.where("__rows = 1").drop("__rows")
    several = once.where("__rows > 1").select(F.col(key).alias("__key"))
    if several.isEmpty():
        return single
    several = materialize(several)
    rows = prep.join(several, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return single.unionByName(token_rows(rows, key).groupBy(key).agg(F.count("*").alias("words"), F.countDistinct("tok").alias("types"), F.sum(F.length("tok")).alias("chars")))


def function_word_rates(counts: Column, n: Column) -> dict[str, Column]:
    """A column for each function word, of their counts in order."""
    return {f"fw_{w}_per_1k": F.when(n > 0, F.element_at(counts, i) * (1000.0 / n)) for i, w in enumerate(lx.FUNCTION_WORDS, 1)}


def register_rate(weights: dict[str, float]) -> Column:
    """Weighted words per thousand of the prepared columns."""
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.when(F.col("n") > 0, 1000.0 * F.aggregate("tok", F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0.0))) / F.col("n"))


def unlikely_english() -> Column:
    """Of prepared columns: mostly letters outside ASCII, or 50 words or more with hardly an English one."""
    letters, plain = _matches("t", r"\p{L}"), _matches("t", "[A-Za-z]")
    known = F.size(F.filter("tok", lambda x: x.isin(*lx.ENGLISH_WORDS)))
    return F.coalesce((F.col("n") > 0) & (letters > 0) & ((plain < 0.5 * letters) | ((F.col("n") >= 50) & (known < 0.05 * F.col("n")))), F.lit(False))


def _wide_columns(areas: tuple[str, ...] | None, among: str = "tok") -> dict[str, Column]:
    columns = _area_columns(among)
    chosen = {m: c for a in areas or columns for m, c in columns.get(a, {}).items()}
    if areas is None or "register" in areas:
        chosen["edited_register_per_1k"] = register_rate(lx.REGISTER)
    return chosen


def wide(prep: DataFrame, areas: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("chunk_id", "document"), raw: str = "text", few: bool = False) -> DataFrame:
    """A column for each metric of the areas (all by default) that JVM expressions and mtld's fold tell; no shuffle.

    Words of all voice lists are found in one pass over the text's, unless few: of callers that read one list or two.
    """
    rows = prep.withColumn("raw", F.col(raw)).withColumn("voiced", _voiced())
    return rows.select(*keep, *[c.alias(m) for m, c in _wide_columns(areas, "tok" if few else "voiced").items()])


def measured(prep: DataFrame, keep: tuple[str, ...] = ("chunk_id", "document"), raw: str = "text") -> DataFrame:
    """All surface metrics of chunks, a column each: a projection, with one Arrow function for what counts word types."""
    rows = prep.withColumns({"raw": F.col(raw), "voiced": _voiced()}).withColumn("vocabulary", vocabulary(F.col("tok"), listed=lx.FUNCTION_WORDS))
    columns = {m: c for m, c in _wide_columns(None, "voiced").items() if m != "mtld"}
    columns |= {m: F.col(f"vocabulary.{m}") for m in ("mattr_100", "mtld", "hapax_share_100")}
    columns |= function_word_rates(F.col("vocabulary.counts"), F.col("n"))
    return rows.select(*keep, *[c.alias(m) for m, c in columns.items()])


def long(metrics: DataFrame, keep: tuple[str, ...] = ("chunk_id", "document"), scored_only: bool = False) -> DataFrame:
    """(keep, grp, metric, value) of a wide table, nulls left out."""
    have = set(metrics.columns)
    rows = [m for m in METRICS if m.metric in have and not (scored_only and m.grp in UNSCORED)]
    each = F.explode(F.array(*[F.struct(F.lit(m.grp).alias("grp"), F.lit(m.metric).alias("metric"), F.col(m.metric).cast("double").alias("value")) for m in rows]))
    return metrics.select(*keep, each.alias("m")).select(*keep, "m.*").where("value IS NOT NULL")


def masked_bigrams(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pattern): neighbouring words, those that aren't function words masked, pairs of masks left out."""
    masked = rows.withColumn("m", F.when(F.col("tok").isin(*lx.FUNCTION_WORDS), F.col("tok")).otherwise("·"))
    pairs = masked.withColumn("next", F.lead("m").over(Window.partitionBy(key).orderBy("pos"))).where("next IS NOT NULL AND NOT (m = '·' AND next = '·')")
    return pairs.select(key, F.concat_ws(" ", "m", "next").alias("pattern"))


def trigrams(prep: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pattern): character trigrams of the prose text."""
    return each(prep, (key,), F.explode_outer(char_trigrams(F.col("t"))).alias("pattern"), "pattern")


#: Patterns with what they read (text, or that with straight apostrophes) and what of a match's start isn't counted.
_SPACES = r"^[^\S\r\n]*"
SPANS = {
    "commas": ("t", ",", None), "semicolons": ("t", ";", None), "colons": ("t", ":", None), "parentheses": ("t", r"\(", None), "questions": ("t", r"\?", None), "exclamations": ("t", "!", None),
    "em_dashes": ("t", lx.EM_DASHES, None), "ellipses": ("t", lx.ELLIPSES, None), "hedges": ("plain", lx.HEDGES, None), "boosters": ("plain", lx.BOOSTERS, None), "llm_markers": ("plain", lx.LLM_MARKERS, None),
    "not_just_but": ("plain", lx.NOT_JUST_BUT, None), "corrective_contrasts": ("plain", lx.CORRECTIVE_CONTRASTS, r"(?i)^[^\S\r\n]*(?:(?:and|but|so)[^\S\r\n]+)?"), "parallel_triads": ("t", lx.PARALLEL_TRIADS, _SPACES),
    "comma_series": ("t", lx.COMMA_SERIES, _SPACES), "semicolon_balances": ("t", lx.SEMICOLON_BALANCES, _SPACES), "colon_reveals": ("t", lx.COLON_REVEALS, _SPACES),
}


def _starts(gaps: pa.Array, hits: pa.Array) -> pa.Array:
    """Where matches start, of the lengths of the gaps before them and of their own."""
    at = gaps.offsets.to_numpy().astype(np.int64) - gaps.offsets[0].as_py()
    gap, hit = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (gaps, hits))
    ends = np.cumsum(gap + hit)
    starts = ends - hit - np.repeat(np.r_[0, ends][at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(starts.astype(np.int32)))


def match_spans(prep: DataFrame, key: str = "chunk_id", metrics: tuple[str, ...] = tuple(SPANS)) -> DataFrame:
    """(key, metric, start, end, text): every match of the counting patterns in the prose text, in characters, ends exclusive.

    Matches and the gaps between them alternate, so offsets are the summed lengths of both: in numpy, as a fold in Spark
    copies what it has so far at each match. Patterns of other metrics than those asked for aren't tried.
    """
    def of(column: str, pattern: str, lead: str | None) -> Column:
        quick, hints = lx.QUICK.get(pattern, (pattern, ()))
        gaps = lambda hits: F.transform(F.slice(F.split(F.col(column), quick, -1), 1, F.size(hits)), F.length)
        found = let(F.regexp_extract_all(F.col(column), F.lit(quick), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, F.struct(gaps(hits).alias("gaps"), hits.alias("hits"))))
        return F.when(_holds(hints), found) if hints else found

    each = F.array(*[F.struct(F.lit(m).alias("metric"), of(*SPANS[m]).alias("f")) for m in metrics])
    rows = prep.select(key, F.explode(each).alias("m")).where("m.f IS NOT NULL").select(key, "m.metric", "m.f.*")
    rows = rows.withColumn("at", F.arrow_udf(_starts, "array<int>")(F.col("gaps"), F.transform("hits", F.length)))
    rows = rows.select(key, "metric", F.explode(F.arrays_zip("at", "hits")).alias("x")).select(key, "metric", "x.at", F.col("x.hits").alias("hit"))
    skip = F.lit(0)
    for m in metrics:
        if SPANS[m][2]:
            skip = F.when(F.col("metric") == m, F.length(F.regexp_extract("hit", SPANS[m][2], 0))).otherwise(skip)
    rows = rows.withColumn("skip", skip)
    return rows.select(key, "metric", (F.col("at") + F.col("skip")).alias("start"), (F.col("at") + F.length("hit")).alias("end"), F.substr("hit", F.col("skip") + 1, F.length("hit")).alias("text"))
