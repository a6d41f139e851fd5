"""Samples, pools and stand-ins over many partitions, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import corpus, patterns


@pytest.mark.parametrize("partitions", [1, 7, 24])
def test_every_kth_over_many_partitions(spark, partitions):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("a"), F.lit(3).alias("n")).repartition(partitions)
    want = list(range(0, 60_000, 100))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, partitions)))
    try:
        for _ in range(2):
            assert sorted(r.a for r in corpus.every_kth(rows, ["a"], "n", budget=1800).collect()) == want
        by = corpus.every_kth(rows.withColumn("g", F.col("a") % 3), ["a"], "n", budget=1800, by=["g"]).collect()
        assert sorted(r.a for r in by) == sorted(a for g in range(3) for a in list(range(g, 60_000, 3))[::34])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def plain_pack(sizes: list[int], words: int) -> list[int]:
    """Windows by lists of items."""
    windows: list[list[int]] = [[]]
    for n in sizes:
        if sum(windows[-1]) * 2 >= words and windows[-1] and sum(windows[-1]) + n > words * 1.5:
            windows.append([])
        windows[-1].append(n)
        if sum(windows[-1]) >= words:
            windows.append([])
    if not windows[-1]:
        windows.pop()
    if len(windows) > 1 and sum(windows[-1]) * 2 < words:
        rest = windows.pop()
        windows[-1] += rest
    return [i for i, w in enumerate(windows) for _ in w]


def test_pools_and_packs_equal_a_plain_loop(spark):
    rng = random.Random(5)
    groups = {g: [rng.choice([1, 2, 5, 9, 30, 55, 130]) for _ in range(rng.randint(1, 60))] for g in range(12)}
    rows = [(g if g else None, i, " ".join(["w"] * n)) for g, sizes in groups.items() for i, n in enumerate(sizes)]
    rows += [(3, 1000 + i, None) for i in range(3)] + [(4, 2000, "...")]
    df = spark.createDataFrame(rows, "g long, i long, text string").repartition(5)
    got = {(r.g or 0, r.window): (r.n, r.texts, r.text) for r in corpus.pool(df, ["g"], "i", "text", 60).collect()}
    want = {}
    for g, sizes in groups.items():
        at = plain_pack(sizes, 60)
        for w in set(at):
            own = [n for n, x in zip(sizes, at) if x == w]
            want[g, w] = (sum(own), len(own), "\n\n".join(" ".join(["w"] * n) for n in own))
    assert got == want
    sizes = spark.createDataFrame([(g, s) for g, s in groups.items()], "g long, s array<int>")
    assert {r.g: r.w for r in sizes.select("g", corpus.packed(F.col("s"), 60).alias("w")).collect()} == {g: plain_pack(s, 60) for g, s in groups.items()}


def test_stand_ins_of_a_large_document(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("d"), "id").repartition(9)
    got: dict = {}
    for r in corpus.stand_ins(rows, "d", "id").collect():
        got.setdefault(r.d, {}).setdefault(r.stand_in, []).append(r.id)
    for ids in got.values():
        assert len(ids) == 8 and all(max(ids[k]) < min(ids[k + 1]) for k in range(7))
        assert {len(x) for x in ids.values()} == {sum(map(len, ids.values())) // 8}


def test_top_k_and_the_rest(spark):
    rows = [(g, f"p{i:03}", 100 - i // 2) for g in (1, 2) for i in range(40)]
    counts = spark.createDataFrame(rows, "g long, pattern string, n long").repartition(6)
    for by in ([], ["g"]):
        merged = counts if by else counts.groupBy("pattern").agg(F.sum("n").alias("n"))
        total = sum(n for _, _, n in rows) / (2 if by else 1)
        each = 1 if by else 2
        got = {(r.g if by else 1, r.pattern): r.share for r in patterns.top_k(merged, by, 5).collect()}
        top = {f"p{i:03}": each * (100 - i // 2) / total for i in range(5)}
        top[patterns.OTHER] = 1 - sum(top.values())
        assert got == pytest.approx({(g, p): s for g in ((1, 2) if by else (1,)) for p, s in top.items()})
    assert patterns.OTHER not in {r.pattern for r in patterns.top_k(counts.where("g = 1"), ["g"], 100).collect()}
