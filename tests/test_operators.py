"""Hand-worked rows and brute force for the stylometry operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions.tokens import sentences, tokens
from inkwell.operators import corpus, measure as m, patterns, reference as ref
from inkwell.operators.vocabulary import vocabulary
from inkwell.plans.measure import QUERIES


def one(spark, text: str, **columns):
    return m.prepared(spark.createDataFrame([(1, "d", text)], "chunk_id long, document string, text string"))


def test_words_and_sentences(spark):
    text = "Don’t stop, Mr. Fox said. No. 5 is far (e.g. Here). \"Really?\" Yes! STRASSE straße x-ray 3.5"
    row = spark.range(1).select(tokens(F.lit(text)).alias("w"), sentences(F.lit(text)).alias("s")).first()
    assert row.w[:4] == ["don't", "stop", "mr", "fox"] and row.w[-5:] == ["strasse", "strasse", "x-ray", "3", "5"]
    assert row.s == ["Don’t stop, Mr. Fox said.", "No. 5 is far (e.g. Here).", "\"Really?\"", "Yes!", "STRASSE straße x-ray 3.5"]


def test_mattr_golden_and_sliding_sets(spark):
    rng = random.Random(3)
    texts = [[f"w{i}" for i in range(120)], ["a", "b"] * 60, [rng.choice("abcdefgh") for _ in range(250)], ["x"] * 99]
    prep = m.prepared(spark.createDataFrame([(i, "d", " ".join(t)) for i, t in enumerate(texts)], "chunk_id long, document string, text string"))
    got = {r.chunk_id: r.mattr_100 for r in prep.select("chunk_id", vocabulary(F.col("tok"))["mattr_100"].alias("mattr_100")).where("mattr_100 IS NOT NULL").collect()}
    want = {i: sum(len(set(t[k : k + 100])) for k in range(len(t) - 99)) / (len(t) - 99) / 100 for i, t in enumerate(texts) if len(t) >= 100}
    assert got == pytest.approx(want) and got[0] == 1.0 and got[1] == pytest.approx(0.02)


def test_masked_bigrams_golden(spark):
    got = patterns.counted(m.masked_bigrams(m.token_rows(one(spark, "The cat sat on the mat."))), []).collect()
    assert {r.pattern: r.n for r in got} == {"the ·": 2, "· on": 1, "on the": 1}


def test_divergence_golden(spark):
    q = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "pattern string, share double")
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "c", 1.0)], "chunk_id long, pattern string, share double")
    assert {r.chunk_id: round(r.divergence, 9) for r in patterns.divergence(p, q, ["chunk_id"]).collect()} == {1: 0.0, 2: 1.0}


def test_rates_of_a_short_text(spark):
    text = "I think it's very good; you never know: we don't... \"No\" (maybe) — yes! Why?"
    row = m.measured(one(spark, text)).first()
    per = 1000.0 / row.words
    assert (row.semicolons_per_1k, row.colons_per_1k, row.em_dashes_per_1k, row.ellipses_per_1k, row.quotations_per_1k) == pytest.approx((per,) * 5)
    assert row.contractions_per_1k == pytest.approx(2 * per) and row.first_singular_per_1k == pytest.approx(per)
    assert row.hedges_per_1k == pytest.approx(2 * per) and row.boosters_per_1k == pytest.approx(2 * per)
    assert row.mattr_100 is None and row.mtld is None


def test_empty_and_null_texts_have_no_rates(spark):
    prep = m.prepared(spark.createDataFrame([(1, "d", None), (2, "d", ""), (3, "d", "***")], "chunk_id long, document string, text string"))
    assert all(r.commas_per_1k is None and r.words == 0 and r.sentence_words_mean is None for r in m.measured(prep).collect())


def test_held_out_z_equals_recomputation(spark):
    values, sources = [1.0, 2.0, 4.0, 3.0, 8.0], list("aabcc")
    rows = spark.createDataFrame([(i, s, "voice", "m", v) for i, (v, s) in enumerate(zip(values, sources))], "chunk_id long, document string, grp string, metric string, value double")
    floor = spark.createDataFrame([("m", 0.0)], "metric string, floor double")
    got = {r.chunk_id: r.z for r in ref.held_out_z(rows, floor).collect()}
    for i, (v, s) in enumerate(zip(values, sources)):
        own = [x for x, t in zip(values, sources) if t != s]
        mean = sum(own) / len(own)
        sd = math.sqrt(sum((x - mean) ** 2 for x in own) / (len(own) - 1))
        assert got[i] == pytest.approx((v - mean) / sd)


def test_delta_and_likeness_golden(spark):
    z = spark.createDataFrame([(1, "d", "punctuation", "semi", 10.0), (1, "d", "punctuation", "comma", 0.0), (1, "d", "voice", "hedge", 1.0)], "chunk_id long, document string, grp string, metric string, z double")
    rms = spark.createDataFrame([("punctuation", "semi", 10.0), ("punctuation", "comma", 1.0), ("voice", "hedge", 1.0)], "grp string, metric string, rms double")
    got = {r.grp: r.delta for r in ref.delta(z, rms).collect()}
    assert got["overall"] == pytest.approx((0.1 / 1.01 + 1) / 2)
    effects = spark.createDataFrame([("g", "em", 2.0, 1.0), ("g", "length", -1.0, 1.0)], "grp string, metric string, effect double, rms double")
    for zs, want in (((1.0, 1.0), 0.8), ((-2.0, 3.0), 0.0), ((None, -2.0), 2.0)):
        rows = [(1, "d", "g", n, v) for n, v in zip(("em", "length"), zs) if v is not None]
        df = spark.createDataFrame(rows, "chunk_id long, document string, grp string, metric string, z double")
        assert ref.likeness(df, effects).first().likeness == pytest.approx(want)


def test_auc_golden_and_brute_force(spark):
    def auc(a, b):
        rows = [(float(x), True) for x in a] + [(float(x), False) for x in b]
        return stats.auc(spark.createDataFrame(rows, "score double, positive boolean")).first().auc

    assert auc([3, 4], [1, 2]) == 1.0 and auc([1], [1]) == 0.5 and auc([2, 0], [1]) == 0.5
    rng = random.Random(1)
    a, b = [rng.randrange(9) for _ in range(60)], [rng.randrange(12) for _ in range(70)]
    assert auc(a, b) == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b) / 4200)


def test_nearest_rank_is_exact(spark):
    rng = random.Random(2)
    groups = {"a": [rng.random() for _ in range(2500)], "b": [1.0, 2.0, 2.0], "c": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, value double")
    got = {r.g: r for r in stats.nearest_rank(df, ("g",), {"p50": F.lit(0.5), "p95": F.lit(0.95)}).collect()}
    for g, vs in groups.items():
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert got[g][name] == sorted(vs)[round(q * (len(vs) - 1))]


def test_packing(spark):
    def pack(sizes, words=10):
        return spark.range(1).select(corpus.packed(F.array(*map(F.lit, sizes)), words).alias("w")).first().w

    assert pack([4, 4, 4, 4]) == [0, 0, 0, 0] and pack([10, 10, 3]) == [0, 1, 1] and pack([6, 12, 9]) == [0, 1, 2]
    assert pack([3]) == [0] and pack([5, 5, 5, 5, 5]) == [0, 0, 1, 1, 2]


def test_duplicates_ignore_case_and_marks(spark):
    long = " ".join(f"word{i}" for i in range(25))
    rows = [(1, long), (2, long.upper() + "!!"), (3, "short one"), (4, "short one"), (5, None), (6, "")]
    got = corpus.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4, 5, 6]


def test_icc_bounds(spark):
    same = spark.createDataFrame([("x", d, float(v)) for d, v in (("a", 1), ("a", 1), ("b", 5), ("b", 5))], "area string, document string, value double")
    row = stats.by_document(same, ("area",)).first()
    assert row.icc == pytest.approx(1.0) and row.effective == pytest.approx(2.0) and row.documents == 2
    alone = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 2.0)], "area string, document string, value double")
    row = stats.by_document(alone, ("area",)).first()
    assert row.icc is None and row.effective == 1.0


def test_t_values():
    assert stats.t_value(0.9, 1) == pytest.approx(3.0777, abs=1e-3) and stats.t_value(0.9, 2) == pytest.approx(1.8856, abs=1e-3)
    assert stats.t_value(0.9, 10) == pytest.approx(1.3722, abs=1e-3)


@pytest.mark.parametrize("name", ["mtld", "phrase_shapes", "paragraph_shape", "all_metrics"])
def test_queries_without_sql_take_all_languages(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).select("chunk_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
