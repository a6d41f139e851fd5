"""What lets queries grow with their input: quick patterns match what the slow ones do, and plans don't do what isn't asked for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions.tokens import SENTENCE_BREAK, folded, sentences
from inkwell.operators import corpus, measure as m

_PARTS = (
    "we it the that's this they're isn't aren't was not just only but and or so about a plan maybe perhaps i think i'm sure seems really very NEVER delve delving crucial it's worth noting İstanbul Straße "
    "however they is are e.g. i.e. No. 5 well one two three four — – -- - ... … , , , ; ; : : . . ! ? ’ ' \" ” ) ( \n \t 😀 notion"
).split(" ")


def random_texts(count: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        parts = [rng.choice(_PARTS) for _ in range(rng.randrange(90))]
        texts.append("".join(p + rng.choice(("", " ", " ", " ", "  ")) for p in parts))
    return texts


def test_quick_patterns_match_the_same(spark):
    given = ["We go; they stay.", "Plans fail: we go on and on until the end: it is a map.", "It isn't a plan, it's a map. This is not the end; it's a start.", "We came, we saw, and we won. a--b - c", *random_texts(3000)]
    hit = dict.fromkeys(lx.QUICK, 0)
    rows = spark.createDataFrame(list(enumerate(given)), "chunk_id long, text string").withColumn("folded", folded(F.col("text")))
    rows = rows.withColumn("slow", F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in lx.QUICK]))
    rows = rows.withColumn("quick", F.array(*[F.when(m._holds(h), F.regexp_extract_all("text", F.lit(q), F.lit(0))).otherwise(F.array().cast("array<string>")) for q, h in lx.QUICK.values()]))
    for r in rows.select("text", "slow", "quick").collect():
        for pattern, slow, quick in zip(lx.QUICK, r.slow, r.quick):
            assert slow == quick, (pattern, r.text)
            hit[pattern] += len(slow)
    assert min(hit.values()) > 0, hit


def test_match_spans_try_no_other_patterns(spark):
    prep = m.prepared(spark.createDataFrame([(1, "One, two: three.")], "chunk_id long, text string"))
    got = m.match_spans(prep, metrics=("commas", "hedges"))
    assert [tuple(r) for r in got.collect()] == [(1, "commas", 3, 4, ",")]
    assert lx._SETUP_WORD not in got._jdf.queryExecution().executedPlan().toString()


def test_match_spans_of_a_long_text_are_found_in_one_pass(spark):
    """Took minutes when each match copied those before it."""
    n = 20_000
    prep = m.prepared(spark.createDataFrame([(1, "a, " * n), (2, "b,"), (3, None)], "chunk_id long, text string"))
    got = m.match_spans(prep, metrics=("commas",)).groupBy("chunk_id").agg(F.count("*"), F.max("start"), F.sum(F.col("end") - F.col("start"))).collect()
    assert sorted(map(tuple, got)) == [(1, n, 3 * (n - 1) + 1, n), (2, 1, 1, 1)]


def test_changed_sequences_by_row_and_by_definition(spark):
    """Repeats within a text, empty and short ones, keys that repeat and null keys."""
    rng = random.Random(3)
    words = lambda: [rng.choice("abcd") for _ in range(rng.choice((0, 2, 5, 9, 30)))]
    rows = [(i % 90 if i else None, " ".join(words()), " ".join(words()) if rng.random() < 0.9 else None) for i in range(120)] + [(500, "a b " * 20, "a b " * 4), (501, "a b c " * 9, "x y z"), (502, "a a a a b", "a a a")]
    got = corpus.ngram_changed(spark.createDataFrame(rows, "pair long, old string, new string"), n=3)
    grams = lambda t: [tuple(w[i : i + 3]) for w in [(t or "").split()] for i in range(len(w) - 2)]
    want = []
    for key, _, _ in rows:
        a = [g for k, o, _ in rows if k == key for g in grams(o)]
        b = {g for k, _, w in rows if k == key for g in grams(w)}
        want.append((key, len(a), sum(g not in b for g in a) / len(a)) if a and key is not None else (key, None, None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got.where("pair > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 2  # sequences of repeated keys only, and their rows


def test_sentences_break_where_the_definition_says(spark):
    texts = ["One. Two! \n\tThree? \"Four.\" Five (six.) Seven e.g. Eight No. 5 vol. 7 Ch. Nine. Dr. Ten.  11 . A", "", *random_texts(1000, 7)]
    rng = random.Random(8)
    parts = [". ", "! ", "?", '." ', ".) ", "e.g. ", "No. ", "Ch.", "vol. ", "pp.", "5", "A", "b", "(B", "“C", "'D", " ", "  ", "\n", "\t", "dr. ", "Mr.", "x"]
    texts += ["".join(rng.choice(parts) for _ in range(40)) for _ in range(1500)]
    slow = F.filter(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), SENTENCE_BREAK), lambda s: s.rlike(r"[\p{L}\p{N}_]"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", slow.alias("slow"), sentences(F.col("text")).alias("quick")).collect()
    assert all(r.slow == r.quick for r in rows) and sum(len(r.quick) for r in rows) > 5000


def test_voice_lists_are_counted_in_one_pass(spark):
    texts = ["I'm sure we don't, you'd never; it’s not ours. Nobody isn't. My own, you’re mine", *random_texts(500, 9)]
    prep = m.prepared(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    names = [f"{k}_per_1k" for k in m._VOICE]
    pooled, apart = (m.wide(prep, ("voice",), ("chunk_id",), few=few).select("chunk_id", *names) for few in (False, True))
    got = sorted(map(tuple, pooled.collect()))
    assert got == sorted(map(tuple, apart.collect())) and all(got[0][1:])
    plan = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(tok#") == 1 and plan.count("filter(voiced#") == len(names)


def test_all_metrics_split_a_text_into_sentences_once(spark):
    """Paragraph metrics split each paragraph twice more."""
    prep = m.prepared(spark.createDataFrame([(1, "d", "One. Two.\n\nThree. Four. Five.")], "chunk_id long, document string, text string"))
    got = m.measured(prep)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(?i:approx|") == 1
    r = got.first()
    assert (r.sentences, r.paragraph_sentences_mean, r.one_sentence_paragraphs_pct) == (5.0, 2.5, 0.0)


def test_token_totals_deal_out_words_of_repeated_keys_only(spark):
    rows = [(1, "a b a c"), (2, ""), (3, "ü é’s"), (4, None)]
    prep = lambda given: m.prepared(spark.createDataFrame(given, "chunk_id long, text string"))
    got = m.token_totals(prep(rows))
    assert sorted(map(tuple, got.collect())) == [(1, 4, 3, 4), (3, 2, 2, 4)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = m.token_totals(prep([*rows, (1, "c d"), (None, "x"), (None, "x y"), (5, "z"), (5, "")]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 6, 4, 6), (3, 2, 2, 4), (None, 3, 2, 3), (5, 1, 1, 1)], key=repr)


def test_samples_evaluate_their_rows_once(spark):
    """The budget, the bounds of buckets and the buckets did so each."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).selectExpr("id", "10 AS n").mapInArrow(count, "id long, n int")
    got = corpus.every_kth(rows, ["id"], "n", budget=1000).collect()
    assert sorted(r.id for r in got) == list(range(0, 3000, 30)) and {r.k for r in got} == {30}
    assert seen.value == 3000


def test_words_and_sentences_are_cut_once_and_for_the_rows_asked_for(spark, sf_dir):
    """A filter on their number, inferred from explode, cut those of all documents before the join with labels."""
    from inkwell.plans.measure import QUERIES, _prep

    writers = m.token_rows(_prep(spark, sf_dir).where("role = 'writer'"))
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (writers, QUERIES["sentence_lengths"](spark, sf_dir), m.trigrams(_prep(spark, sf_dir)))]
    assert all(p.count("split(coalesce(text#") == 1 for p in plans)


def test_setup_computes_what_a_query_asks_for(spark, sf_dir):
    """All roles were measured, and held-out z and drafts' ranges computed, whatever a query reads."""
    from inkwell.plans.reference import QUERIES, Setup

    s = Setup(spark, sf_dir, QUERIES["mean_ceilings"].roles)
    assert {r.role for r in s.rows.select("role").distinct().collect()} == {"writer"}
    assert s.floors.count() == 10 and not {"z", "contrast_z", "draft_z", "drafts"} & set(vars(s))
