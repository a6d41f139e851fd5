"""Queries over tokens and row metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions.registry import METRICS, UNSCORED, registry
from inkwell.operators import measure as m
from inkwell.operators.vocabulary import vocabulary
from inkwell.plans.base import SQL_BASE, SQL_VALUES, _W, chunks, count_in, matches, per_1k, values


def _rounded(df: DataFrame) -> DataFrame:
    """Six decimals as the SQL has them: of 10^6 times the value, while F.round(c, 6) takes its shortest decimals and ends ties elsewhere."""
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.prepared(chunks(spark, sf_dir))


def tokens_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each chunk: count, distinct and characters."""
    return m.token_totals(_prep(spark, sf_dir))


def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence's number of words."""
    return m.each(_prep(spark, sf_dir), ("chunk_id",), F.posexplode_outer("lens").alias("pos", "n"), "pos").select("chunk_id", F.col("pos").cast("long").alias("pos"), "n")


def _area(name: str, *areas: str, keep=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = m.wide(_prep(spark, sf_dir), areas, ("chunk_id",))
        return _rounded(got.select("chunk_id", *keep) if keep else got)

    query.__name__, query.__doc__ = name, f"Metrics of the areas {', '.join(areas)}."
    return query


SHAPE = ("sentence_words_mean", "sentence_words_median", "sentence_words_sd", "short_sentences_pct", "long_sentences_pct")
sentence_shape = _area("sentence_shape", "sentence_shape", keep=SHAPE)
rhythm = _area("rhythm", "rhythm")
vocabulary_basic = _area("vocabulary_basic", "vocabulary", keep=("word_chars_mean", "long_words_pct"))
mtld = _area("mtld", "vocabulary", keep=("mtld",))
punctuation_rates = _area("punctuation_rates", "punctuation")
voice_rates = _area("voice_rates", "voice", keep=("contractions_per_1k", "first_singular_per_1k", "first_plural_per_1k", "second_person_per_1k", "negations_per_1k", "hedges_per_1k", "boosters_per_1k", "llm_markers_per_1k", "not_just_but_per_1k", "and_but_so_openers_pct", "transition_openers_pct"))
phrase_shapes = _area("phrase_shapes", "voice", "rhetoric", keep=("corrective_contrasts_per_1k", "parallel_triads_per_1k", "comma_series_per_1k", "semicolon_balances_per_1k", "colon_reveals_per_1k"))
emoji_bullets = _area("emoji_bullets", "social")
edited_register = _area("edited_register", "register")
paragraph_shape = _area("paragraph_shape", "size", "sentence_shape", keep=("words", "sentences", "paragraphs", "apostrophes", "paragraph_sentences_mean", "paragraph_words_mean", "one_sentence_paragraphs_pct"))


def mattr_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-average type/token ratio of chunks of 100 words or more."""
    return _rounded(_prep(spark, sf_dir).select("chunk_id", vocabulary(F.col("tok"), ("mattr_100",))["mattr_100"].alias("mattr_100")).where("mattr_100 IS NOT NULL"))


def hapax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of word types used once in complete blocks of 100 words."""
    return _rounded(_prep(spark, sf_dir).select("chunk_id", vocabulary(F.col("tok"), ("hapax_share_100",))["hapax_share_100"].alias("hapax_share_100")).where("hapax_share_100 IS NOT NULL"))


def function_word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each of the 93 function words in each chunk, zeros included."""
    prep = _prep(spark, sf_dir).where("n > 0").select("chunk_id", "n", vocabulary(F.col("tok"), ("counts",), lx.FUNCTION_WORDS)["counts"].alias("counts"))
    each = prep.select("chunk_id", "n", F.posexplode("counts").alias("at", "count"))
    return each.select("chunk_id", F.element_at(F.array(*map(F.lit, lx.FUNCTION_WORDS)), F.col("at") + 1).alias("word"), F.round(F.col("count") * (1000.0 / F.col("n")), 6).alias("rate"))


def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents of all languages are unlikely to be English."""
    return _prep(spark, sf_dir).select("chunk_id", m.unlikely_english().alias("unlikely"))


def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many metrics each area has."""
    return registry(spark).groupBy("grp").agg(F.count("*").alias("metrics"), F.count_if("scored").alias("scored"), F.count_if("syntax").alias("syntax"))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in long form."""
    return _rounded(values(spark, sf_dir))


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 145 surface metrics of each document of any language, a column each."""
    return _rounded(m.measured(_prep(spark, sf_dir)))


_list = ", ".join(f"'{w}'" for w in lx.FUNCTION_WORDS)
_weights = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in lx.REGISTER.items())
_sent_share = lambda p: "100.0::DOUBLE * count(*) FILTER (regexp_matches(s, '" + p.replace("'", "''") + "')) / count(*)"
_en = ", ".join(f"'{w}'" for w in lx.ENGLISH_WORDS)
_metrics = ", ".join(f"('{x.grp}', {x.grp not in UNSCORED}, {x.syntax})" for x in METRICS)
#: Paragraphs between blank lines, and their sentences by the rule of SQL_BASE.
_PARAGRAPHS = rf"""pg AS (SELECT chunk_id, unnest(p) AS t, unnest(range(len(p))) AS k FROM (SELECT chunk_id, string_split(regexp_replace(coalesce(raw, ''), '\n[ \t>]*\n', chr(30), 'g'), chr(30)) AS p FROM base)),
pt AS (SELECT chunk_id, k, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM pg WHERE regexp_matches(t, '[\pL\pN_]')),
pp AS (SELECT chunk_id, k, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (SELECT chunk_id, k, string_split(regexp_replace(t, '([.!?]["''”’)\]]?)\s+(["“''‘(\[]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS p FROM pt)),
pi AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id, k ORDER BY pos) AS g FROM (SELECT *, coalesce(regexp_matches(lag(piece) OVER w, '(?i)(?:^|[^\pL\pN_])(?:e\.g|i\.e|vs|mr|mrs|ms|dr|st|jr|sr|fig|approx)\.$')
  OR (regexp_matches(lag(piece) OVER w, '(?:^|[^\pL\pN_])(?:No|Nos|[Vv]ol|pp|[Cc]h)\.$') AND regexp_matches(piece, '^[0-9]')), false) AS glued FROM pp WINDOW w AS (PARTITION BY chunk_id, k ORDER BY pos))),
ps AS (SELECT chunk_id, k, count(*) AS s FROM (SELECT chunk_id, k, g, string_agg(piece, ' ' ORDER BY pos) AS s FROM pi GROUP BY ALL) WHERE regexp_matches(s, '[\pL\pN_]') GROUP BY ALL),
pa AS (SELECT chunk_id, count(*) AS paragraphs, sum(s) AS sentences, avg(s) AS a, avg(len(regexp_extract_all(t, '{_W}'))) AS b, 100.0::DOUBLE * count(*) FILTER (s = 1) / count(*) AS c FROM pt JOIN ps USING (chunk_id, k) GROUP BY 1)"""
_lone = "len(tok) >= 300 AND paragraphs = 1"
SQL = {
    "metric_registry": f"SELECT grp, count(*) AS metrics, count(*) FILTER (scored) AS scored, count(*) FILTER (syntax) AS syntax FROM (VALUES {_metrics}) m(grp, scored, syntax) GROUP BY 1",
    "paragraph_shape": f"WITH {SQL_BASE}, {_PARAGRAPHS} SELECT chunk_id, CAST(len(tok) AS DOUBLE) AS words, CAST(coalesce(sentences, 0) AS DOUBLE) AS sentences, CAST(coalesce(paragraphs, 0) AS DOUBLE) AS paragraphs, CAST({matches(chr(91) + chr(39) + '‘’]')} AS DOUBLE) AS apostrophes, CASE WHEN NOT ({_lone}) THEN round(a, 6) END AS paragraph_sentences_mean, CASE WHEN NOT ({_lone}) THEN round(b, 6) END AS paragraph_words_mean, CASE WHEN NOT ({_lone}) THEN round(c, 6) END AS one_sentence_paragraphs_pct FROM lists LEFT JOIN pa USING (chunk_id)",
    "tokens_words": f"WITH {SQL_BASE} SELECT chunk_id, count(*) AS words, count(DISTINCT tok) AS types, CAST(sum(length(tok)) AS BIGINT) AS chars FROM toks GROUP BY chunk_id",
    "sentence_lengths": f"WITH {SQL_BASE} SELECT chunk_id, pos, n FROM sents",
    "sentence_shape": f"WITH {SQL_BASE} SELECT chunk_id, {', '.join(f'round({c}, 6) AS {c}' for c in SHAPE)} FROM base LEFT JOIN shape USING (chunk_id)",
    "rhythm": f"WITH {SQL_BASE} SELECT chunk_id, round(sentence_length_cv, 6) AS sentence_length_cv, round(sentence_length_change_mean, 6) AS sentence_length_change_mean FROM base LEFT JOIN shape USING (chunk_id)",
    "vocabulary_basic": f"WITH {SQL_BASE} SELECT chunk_id, round(word_chars_mean, 6) AS word_chars_mean, round(long_words_pct, 6) AS long_words_pct FROM words",
    "punctuation_rates": f"WITH {SQL_BASE} SELECT chunk_id, " + ", ".join(f"round({per_1k(c)}, 6) AS {n}_per_1k" for n, c in {"commas": matches(","), "semicolons": matches(";"), "colons": matches(":"), "em_dashes": matches("—") + " + " + matches(r"[\pL\pN_]--[\pL\pN_]") + " + " + matches(r"[\pL\pN_] --? [\pL\pN_]"), "parentheses": matches(r"\("), "questions": matches(r"\?"), "exclamations": matches("!"), "ellipses": matches(r"\.\.\.|…"), "quotations": matches("“") + " + " + matches('"') + " // 2"}.items()) + " FROM lists",
    "voice_rates": f"WITH {SQL_BASE}, o AS (SELECT chunk_id, {_sent_share(lx.AND_BUT_SO_OPENERS)} AS a, {_sent_share(lx.TRANSITION_OPENERS)} AS b FROM sents GROUP BY chunk_id) SELECT chunk_id, "
    + ", ".join(f"round({per_1k(c)}, 6) AS {n}_per_1k" for n, c in {"contractions": count_in(lx.S_CONTRACTIONS, lx.CONTRACTION_ENDS), "first_singular": count_in(lx.FIRST_SINGULAR), "first_plural": count_in(lx.FIRST_PLURAL), "second_person": count_in(lx.SECOND_PERSON), "negations": count_in(lx.NEGATIONS, ("n't",)), "hedges": matches(lx.HEDGES, "replace(t, '’', '''')"), "boosters": matches(lx.BOOSTERS, "replace(t, '’', '''')"), "llm_markers": matches(lx.LLM_MARKERS, "replace(t, '’', '''')"), "not_just_but": matches(lx.NOT_JUST_BUT, "replace(t, '’', '''')")}.items())
    + ", round(o.a, 6) AS and_but_so_openers_pct, round(o.b, 6) AS transition_openers_pct FROM lists LEFT JOIN o USING (chunk_id)",
    "emoji_bullets": f"WITH {SQL_BASE} SELECT chunk_id, round({per_1k(matches(lx.SYMBOL_BULLETS.replace('(?md)', '(?m)'), 'raw'))}, 6) AS symbol_bullets_per_1k, round({per_1k(matches(lx.EMOJI, 'raw'))}, 6) AS emoji_per_1k FROM lists",
    "edited_register": f"WITH {SQL_BASE}, r(word, weight) AS (VALUES {_weights}), s AS (SELECT chunk_id, sum(weight) AS s FROM toks JOIN r ON tok = word GROUP BY chunk_id) SELECT chunk_id, round(CASE WHEN len(tok) > 0 THEN 1000.0::DOUBLE * coalesce(s, 0) / len(tok) END, 6) AS edited_register_per_1k FROM lists LEFT JOIN s USING (chunk_id)",
    "mattr_100": f"WITH {SQL_BASE}, w AS (SELECT chunk_id, count(DISTINCT tok) AS d FROM (SELECT a.chunk_id, a.pos AS p, b.tok FROM (SELECT DISTINCT chunk_id, pos FROM toks) a JOIN toks b ON a.chunk_id = b.chunk_id AND b.pos BETWEEN a.pos AND a.pos + 99 JOIN words n ON n.chunk_id = a.chunk_id AND a.pos <= n.n - 100) GROUP BY chunk_id, p) SELECT chunk_id, round(avg(d) / 100, 6) AS mattr_100 FROM w GROUP BY chunk_id",
    "hapax_share": f"WITH {SQL_BASE}, c AS (SELECT chunk_id, pos // 100 AS b, tok, count(*) AS c FROM toks GROUP BY ALL), s AS (SELECT chunk_id, b, 100.0::DOUBLE * count(*) FILTER (c = 1) / count(*) AS share, sum(c) AS n FROM c GROUP BY ALL) SELECT chunk_id, round(avg(share), 6) AS hapax_share_100 FROM s WHERE n = 100 GROUP BY chunk_id",
    "function_word_rates": f"WITH {SQL_BASE}, c AS (SELECT chunk_id, tok, count(*) AS c FROM toks GROUP BY ALL), f AS (SELECT unnest([{_list}]) AS word) SELECT l.chunk_id, word, round(coalesce(c, 0) * (1000.0::DOUBLE / len(l.tok)), 6) AS rate FROM lists l CROSS JOIN f LEFT JOIN c ON c.chunk_id = l.chunk_id AND c.tok = word WHERE len(l.tok) > 0",
    "language_check": f"WITH {SQL_BASE} SELECT chunk_id, len(tok) > 0 AND {matches(chr(92) + 'pL')} > 0 AND ({matches('[A-Za-z]')} < 0.5::DOUBLE * {matches(chr(92) + 'pL')} OR (len(tok) >= 50 AND len(list_filter(tok, lambda x: x IN ({_en}))) < 0.05::DOUBLE * len(tok))) AS unlikely FROM lists",
    "metrics_long": f"WITH {SQL_VALUES} SELECT chunk_id, document, role, words, grp, metric, round(value, 6) AS value FROM vals",
}
QUERIES = {f.__name__: f for f in (tokens_words, sentence_lengths, sentence_shape, paragraph_shape, rhythm, vocabulary_basic, mtld, punctuation_rates, voice_rates, phrase_shapes, emoji_bullets, edited_register, mattr_100, hapax_share, function_word_rates, language_check, metric_registry, metrics_long, all_metrics)}
