"""Tables that hold what may go wrong: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHES = ("fp", "key", "id", "mark", "dropped", "k", "size", "component_id", "row", "found", "label", "score", "m", "taken", "lines_dropped", "fingerprint", "kept")


def prose(n: int, seed: int) -> str:
    random_ = random.Random(seed)
    words = "the river stone and old house by water under green hill where people walk slowly home from market".split()
    return " ".join(random_.choice(words) + random_.choice(["", "", "", "."]) for _ in range(n))


def messy_documents() -> list[tuple]:
    passage = prose(60, 1)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t", None, None, 5), (4, "*** 123 ###", "en", "b", 11),
        (None, prose(30, 2), "en", "a", None), (None, prose(30, 2), "en", "a", None), (5, passage, "en", "a", 1), (5, passage, "en", "a", 1),
        (6, passage + " and more", None, "b", 1), (7, "été à la maison où le chien dort près du feu " * 3, "fr", None, 1), (8, prose(60_000, 3), "en", "b", 1),
        (9, "one line here\n" * 4 + "password = hunter2hunter2", "en", "c", 1), (10, "😀 emoji ünïcode ſ İ", "de", "c", 1),
    ]
    return rows + [(20 + i, f"shared footer number {i}\n{prose(12, 50 + i)}", ["en", "fr"][i % 2], "c", 1) for i in range(8)]


def _write(spark: SparkSession, folder: str, full: bool) -> str:
    def put(name: str, rows: list[tuple], schema: str, clashes: bool = True) -> None:
        df = spark.createDataFrame(rows if full else [], schema)
        if clashes:
            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns})
        df.write.parquet(f"{folder}/{name}.parquet")

    put("documents", messy_documents(), "doc_id long, text string, lang string, source string, n_chars long")
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.05, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0]), (9, [0.0, 1.0]), (10, []), (11, [0.0, 0.0, 1.0])]
    put("embeddings", [(i, v, None) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    put("labels", [(5, 1, 0), (5, 1, 0), (6, 0, None), (8, None, 0), (None, 1, 1), (20, 0, 0), (21, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int", clashes=False)
    put("benchmark", [(1, passage_item()), (1, passage_item()), (2, None), (None, passage_item()), (3, ""), (4, "too short")], "item_id long, text string")
    return folder


def passage_item() -> str:
    return prose(60, 1)


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory) -> str:
    return _write(spark, str(tmp_path_factory.mktemp("messy")), True)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory) -> str:
    return _write(spark, str(tmp_path_factory.mktemp("empty")), False)
