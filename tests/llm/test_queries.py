"""Every query against DuckDB or brute force on the driver's smallest tables, and on messy and empty ones."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from inkwell.llm import queries
from tests.conftest import same_as_sql

ROWS = {"op1_embedding_dedup": 13, "op2_repeated_bytes": 21, "op3_token_counts": 21, "op5_simhash": 21, "op6_line_dedup": 21, "op7_mix_sources": 21, "op8_quality": 21, "op9_language": 21, "op10_secrets": 21}


def texts(spark, sf_dir) -> list[tuple]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def joined(n: int, links) -> list[int]:
    """The smallest index linked to each."""
    root = list(range(n))

    def of(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = of(a), of(b)
        root[max(a, b)] = min(a, b)
    return [of(i) for i in range(n)]


@pytest.mark.parametrize("name", queries.QUERIES)
def test_messy_tables(spark, messy, name):
    got = queries.QUERIES[name](spark, messy).collect()
    assert name not in ROWS or len(got) == ROWS[name]
    assert name == "op4_decontaminate" or all(r[0] is None or isinstance(r[0], int) for r in got)


def test_messy_values(spark, messy):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns: the rows that a plain loop gives."""
    import tiktoken

    from inkwell.llm.token_counts import PATTERN, read_ranks

    run = lambda name: queries.QUERIES[name](spark, messy).collect()
    all_texts = texts(spark, messy)
    raw = [(t or "").encode() for _, t in all_texts]
    assert Counter(tuple(r)[:5] for r in run("op2_repeated_bytes")) == Counter((i, *digest(t, g)) for (i, _), t, g in zip(all_texts, raw, removed(raw, 200)))
    tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(queries.TOKENIZER), special_tokens={})
    assert Counter(map(tuple, run("op3_token_counts"))) == Counter((i, len(tokenizer.encode_ordinary(t or ""))) for i, t in all_texts)
    found = Counter((r.doc_id, r.item_id) for r in run("op4_decontaminate"))
    assert found == Counter({(5, 1): 4, (5, None): 2, (6, 1): 2, (6, None): 1})  # two rows of id 5, two equal items
    prints = [simhash(t) for _, t in all_texts]
    assert Counter((r.doc_id, r.fingerprint) for r in run("op5_simhash")) == Counter((i, f"{p:016x}") for (i, _), p in zip(all_texts, prints))
    assert {r.component_id for r in run("op5_simhash") if r.fingerprint == "0" * 16} == {1}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in run("op6_line_dedup") if r.doc_id is not None}
    assert lines[1] == (0, 0) and lines[2] == (1, 0) and lines[9] == (5, 0) and lines[20] == (2, 0) and all(lines[i] == (2, 1) for i in range(21, 28))
    scores: dict = {}
    for r in run("op8_quality"):
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[5]) == len(scores[None]) == 1 and scores[1] == scores[2]
    assert Counter(r.lang_pred for r in run("op9_language") if r.doc_id in (1, 2, 3, 4)) == {"und": 4}
    secrets = {r.doc_id: r for r in run("op10_secrets") if r.doc_id is not None}
    assert all((secrets[i].n_assign, secrets[i].n_access, secrets[i].n_hex) == (len(base_spans(t or "")), 0, 0) for i, t in all_texts if i is not None)
    assert secrets[9].n_assign == 1 and secrets[1].spans == ""


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", queries.SQL)
def test_same_as_sql(spark, sf_dir, name):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


def test_op7_messy_same_as_sql(spark, messy):
    same_as_sql(queries.op7_mix_sources(spark, messy), queries.SQL["op7_mix_sources"], messy)


def test_op1_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    place = {int(o): k for k, o in enumerate(order)}
    root = joined(len(ids), [(place[int(a)], place[int(b)]) for a, b in zip(*np.nonzero(near))])
    want = {ids[i]: (int(near[i].sum()), ids[order[root[place[i]]]]) for i in range(len(ids))}
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_embedding_dedup(spark, sf_dir).collect()}
    assert got == want


def test_op1_edges(spark, messy):
    got = {r.vec_id: r for r in queries.op1_embedding_dedup(spark, messy).collect() if r.vec_id is not None}
    assert (got[1].n_links, got[1].component_id, got[1].kept) == (3, 1, True)
    assert (got[2].n_links, got[2].component_id, got[2].kept) == (3, 1, False)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert (got[8].n_links, got[8].component_id) == (3, 1)


def removed(all_texts: list[bytes], span: int) -> list[np.ndarray]:
    starts = defaultdict(list)
    for k, t in enumerate(all_texts):
        for i in range(len(t) - span + 1):
            starts[t[i : i + span]].append((k, i))
    gone = [np.zeros(len(t), bool) for t in all_texts]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + span] = True
    return gone


def digest(text: bytes, gone: np.ndarray) -> tuple:
    runs = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)
    return len(text), int(gone.sum()), len(runs), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def test_op2_brute_force(spark, sf_dir):
    all_texts = texts(spark, sf_dir)
    raw = [(t or "").encode() for _, t in all_texts]
    want = {i: digest(t, g) for (i, _), t, g in zip(all_texts, raw, removed(raw, 200))}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_repeated_bytes(spark, sf_dir).collect()}
    assert got == want
    assert any(w[1] for w in want.values())


def test_op3_counts_tokens(spark, sf_dir):
    import tiktoken

    from inkwell.llm.token_counts import PATTERN, read_ranks

    tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(queries.TOKENIZER), special_tokens={})
    want = {i: len(tokenizer.encode_ordinary(t or "")) for i, t in texts(spark, sf_dir)}
    assert {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, sf_dir).collect()} == want


def test_op4_finds_passages(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.op4_decontaminate(spark, sf_dir).collect()}
    whole = {(i, k) for i, t in texts(spark, sf_dir) for k, x in items.items() if t and x in t and len(x.split()) >= 8}
    assert whole and whole <= set(got)
    assert all(0.5 <= r.score <= 1 and r.start < r.end for r in got.values())
    assert all(got[x].score > 0.99 for x in whole)


def simhash(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5_brute_force(spark, sf_dir):
    rows = sorted(texts(spark, sf_dir))
    fp = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = joined(len(fp), links)
    want = {rows[i][0]: (f"{fp[i]:016x}", rows[root[i]][0]) for i in range(len(rows))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf_dir).collect()} == want


def test_op6_is_native(spark, sf_dir):
    plan = queries.op6_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op7_stops_at_three_epochs(spark, sf_dir):
    rows = queries.op7_mix_sources(spark, sf_dir).collect()
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    longest = max(r.size for r in rows)
    assert all(abs(t - target) <= longest for (_, target), t in taken.items())


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_quality(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").where("quality IS NOT NULL")
    rows = got.join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(good) > 50 and len(bad) > 50 and auc > 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").where("lang IS NOT NULL")
    rows = queries.op9_language(spark, sf).where("held_out").join(docs, "doc_id").collect()
    lettered = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    assert np.mean([r.lang_pred == r.lang for r in lettered]) > 0.95
    assert all(r.lang_pred == "und" for r in rows if not r.text or not any(c.isalpha() for c in r.text))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_op10_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_secrets(spark, sf).collect()}
    some = 0
    for i, t in texts(spark, sf):
        spans = base_spans(t or "")
        some += bool(spans)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert some
