"""build, save, load, score and evaluate on small texts of two made writers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell import api
from inkwell.streaming.scoring import score_stream

PLAIN = "we saw the old house by the river and it was quiet there when the rain came down on us".split()
FANCY = "moreover the multifaceted landscape certainly leverages crucial robust paradigms however furthermore additionally".split()


def text(words: list[str], n: int, seed: int, mark: str) -> str:
    rng = random.Random(seed)
    out, k = [], 0
    while k < n:
        size = rng.randint(4, 14)
        out.append(" ".join(rng.choice(words) for _ in range(size)).capitalize() + mark)
        k += size
    return " ".join(out)


def sets(spark):
    rows = lambda side, words, mark, n: [(f"{side}{i}", f"{side} {i % n}", "\n".join(text(words, 105, 310 * i + k + len(words), mark) for k in range(10))) for i in range(24)]
    return [spark.createDataFrame(r, "doc_id string, document string, text string") for r in (rows("w", PLAIN, ".", 12), rows("c", FANCY, ";", 12))]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    writer, contrast = sets(spark)
    profile = api.build(writer.unionByName(writer.limit(2).withColumn("doc_id", F.concat(F.lit("z"), "doc_id"))), contrast, api.Settings(window=300))
    folder = str(tmp_path_factory.mktemp("profile"))
    profile.save(folder)
    return api.Profile.load(spark, folder), folder


def test_a_profile_tells_writers_apart(spark, built):
    profile, _ = built
    assert profile.settings.window == 300 and profile.likeness.first().auc > 0.95
    assert {r.covers for r in profile.points.where("area = 'overall'").collect()} >= {75.0, 150.0}
    drafts = [("own", "own", text(PLAIN, 400, 991, ".")), ("other", "other", text(FANCY, 400, 992, ";")), ("short", "short", "Too short."), ("none", "none", None)]
    scores = profile.scores(spark.createDataFrame(drafts, "doc_id string, document string, text string"))
    got = {r.chunk_id: r for r in scores.chunks.collect()}
    assert set(got) == {"own", "other", "short"}
    assert got["own"].verdict in ("close", "somewhat different") and got["other"].verdict == "very different" and got["short"].verdict == "too short to judge"
    assert got["other"].likeness > got["own"].likeness
    assert {r.grp for r in scores.areas.where("chunk_id = 'own'").collect()} >= {"overall", "voice", "function_words", "punctuation"}
    assert scores.deviations.where("chunk_id = 'other'").count() == 8 and scores.signals.where("chunk_id = 'other'").count() == 5
    documents = {r.document: r for r in scores.documents().collect()}
    assert documents["other"].reason.startswith("distance") and documents["short"].reason == "no chunk is long enough"
    assert {r.document for r in scores.failing(level=2).collect()} == {"other"}


def test_a_foreign_paragraph_drifts(spark, built):
    profile, _ = built
    null = profile.null.first()
    assert null.documents >= 10 and null.high is not None and null.scale is not None
    own = [text(PLAIN, 130, 70 + k, ".") for k in range(6)]
    mixed = [*own[:3], text(FANCY, 130, 80, ";"), *own[3:]]
    rows = [("own", "own", "\n".join(own)), ("mixed", "mixed", "\n".join(mixed)), ("short", "short", "a few words"), ("none", "none", None)]
    got = profile.drift(spark.createDataFrame(rows, "doc_id string, document string, text string")).collect()
    assert {(r.chunk_id, r.pos) for r in got} == {("own", k) for k in range(6)} | {("mixed", k) for k in range(7)}
    assert [r.pos for r in got if r.drifts] == [3] and all(r.chunk_id == "mixed" and r.line == 4 for r in got if r.drifts)


def test_other_versions_are_refused(spark, built, tmp_path):
    profile, _ = built
    profile.save(str(tmp_path))
    spark.createDataFrame([(99, 0, "{}")], "version int, minor int, settings string").write.mode("overwrite").parquet(f"{tmp_path}/made")
    with pytest.raises(ValueError, match="newer"):
        api.Profile.load(spark, str(tmp_path))


def test_evaluation_of_edits(spark, built):
    writer, contrast = sets(spark)
    edited = contrast.withColumn("text", F.regexp_replace("text", ";", ".")).unionByName(contrast.limit(1).withColumn("document", F.lit("nobody")))
    got = api.evaluate(built[0], contrast, edited, writer)
    left = {r.metric: r.remaining for r in got.survival.collect()}
    assert len(left) == 10 and any(x is not None and abs(x) < 0.2 for x in left.values())
    assert [r.document for r in got.unmatched.collect()] == ["nobody"]
    assert got.retrained.first().auc > 0.9 and got.edited.where("document = 'nobody' AND likeness IS NOT NULL").count() == 0


def test_few_long_texts_are_split_and_short_ones_pooled(spark):
    long = "\n\n".join(f"# Part {k}\n\n{text(PLAIN, 400, k, '.')}" for k in range(4))
    docs = spark.createDataFrame([("a", "a", long), ("b", "b", "short text")], "doc_id string, document string, text string")
    got = api.divided(docs, api.Settings(window=300, markdown=True)).collect()
    assert {r.document for r in got} == {"a#1", "a#2", "a#3", "a#4", "b"}
    assert api.divided(docs, api.Settings(markdown=True, split="never")).count() == 2
    turns = spark.createDataFrame([(f"{i:04}", f"d{i % 4}", "some few words here") for i in range(800)], "doc_id string, document string, text string")
    pool = api.pooled(turns, api.Settings(window=100))
    assert pool.count() == 32 and api.pooled(turns, api.Settings(window=1000)) is None and api.pooled(docs, api.Settings(pool="never")) is None


def test_scores_of_a_stream(spark, built, tmp_path):
    spark.createDataFrame([("s1", "s1", text(PLAIN, 300, 5, ".")), ("s2", "s2", text(FANCY, 300, 6, ";"))], "doc_id string, document string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, document string, text string").parquet(f"{tmp_path}/in")
    query = score_stream(stream, built[0], f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = {r.chunk_id: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"s1", "s2"} and got["s2"] == "very different"
