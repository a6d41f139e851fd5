"""Secret scans with corpus-wide ownership frequency.

Three base kinds are matched as regular expressions (assign, access, hex). Besides, any run of 20 or more token
characters that mixes digits with upper and lower case is a candidate. Hashes of all candidate values, base ones
included, are counted over the whole corpus by distinct repositories (here: documents) and owners (here: sources). A
value that over `most_owners` owners or over `most_repositories` repositories hold is a copied example (of a tutorial, of
a template that one owner deals out); the others belong to an owner and look live. The method adds the live candidates
as spans of kind `key`; base spans stay whatever their counts.

Offsets are code points, end exclusive; bytes that aren't UTF-8 count as a replacement character. Null texts count as
empty, a very long text is scanned whole. Null owners are one owner. Each row is a document, also one that repeats an id
or has none. A candidate that overlaps a base span isn't one of its own. Other columns, of whatever names, aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, slices, utf8

KINDS = ("assign", "access", "hex", "key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run holds at most one
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("base_sha256", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of (start, kind, end), by start, then kind."""
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in sorted(spans))


def scan_text(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base spans and of candidates, by start."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _RUN.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not any(i < m.end() and m.start() < j for i, _, j, _ in base):
            found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def _worth_a_look(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: a sign of assignment, or a run of 20 token characters (every other kind is one)."""
    token = np.zeros(256, bool)
    token[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
    flag = np.zeros(len(data) + 1, bool)
    flag[:-1] = (data == 58) | (data == 61)
    part = token[data]
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    edge = np.r_[0, edge, len(data)]
    long = edge[:-1][(np.diff(edge) >= 20) & part[np.minimum(edge[:-1], len(data) - 1)]] if len(data) else edge[:0]
    flag[long] = True
    for i in long[np.searchsorted(starts, long, "right") < len(starts)]:  # a run may go on over a document's end
        nxt = starts[np.searchsorted(starts, i, "right")]
        while nxt < len(data) and part[nxt] and part[nxt - 1]:
            flag[nxt] = True
            later = starts[np.searchsorted(starts, nxt, "right") :]
            if not len(later):
                break
            nxt = later[0]
    return np.add.reduceat(np.r_[flag, False], np.minimum(starts[:-1], len(data)), dtype=np.int64) * (starts[1:] > starts[:-1]) > 0 if len(starts) > 1 else np.zeros(0, bool)


def _scanned(batches):
    empty = hashlib.sha256(b"").hexdigest()
    for b in batches:
        data, starts = utf8(b.column(b.schema.get_field_index("text")))
        n = len(starts) - 1
        counts, base, sha, found = np.zeros((3, n), np.int64), [""] * n, [empty] * n, [[] for _ in range(n)]
        for i, j in slices(starts):
            own = starts[i : j + 1] - starts[i]
            for k in np.flatnonzero(_worth_a_look(data[starts[i] : starts[j]], own)) + i:
                spans = scan_text(data[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "replace"))
                if spans:
                    own_base = [(s, kind, e) for s, kind, e, _ in spans if kind < 3]
                    for _, kind, _ in own_base:
                        counts[kind, k] += 1
                    base[k] = joined(own_base)
                    sha[k] = hashlib.sha256(base[k].encode()).hexdigest()
                    found[k] = [{"kind": kind, "start": s, "end": e, "value": xxhash.xxh64_intdigest(v, 42) - (1 << 63)} for s, kind, e, v in spans]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).cast(_SCHEMA.field(c).type) for c in ("doc_id", "owner")] + [pa.array(c) for c in counts] + [pa.array(base), pa.array(sha), pa.array(found, _SCHEMA.field("found").type)], schema=_SCHEMA)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 2, most_repositories: int = 100) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found) of all documents.

    n_live and n_example count the document's values, base ones included, by ownership; found lists every value's kind,
    span, hash, owners, repositories and whether it looks live.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    seen = materialize(rows.mapInArrow(_scanned, "doc_id long, owner string, n_assign long, n_access long, n_hex long, base string, base_sha256 string, found array<struct<kind:int,start:long,end:long,value:long>>").withColumn("row", F.monotonically_increasing_id()))
    each = seen.select("row", F.coalesce(F.concat(F.lit("s"), "owner"), F.lit("n")).alias("owner"), F.explode("found").alias("f")).select("row", "owner", "f.*")
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("value").agg(F.count("*").alias("owners"))
    repos = each.select("value", "row").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    known = materialize(owners.join(repos, "value"))
    judged = each.join(known, "value").withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    lists = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "live"))).alias("found"),
    )
    out = seen.drop("found").join(lists, "row", "left").drop("row")
    span = lambda f: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string"))
    shown = F.filter("found", lambda f: (f["kind"] < 3) | f["live"])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(F.transform(shown, span), ","), F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("found", lambda f: f["live"])), F.lit(0)).alias("n_live"), F.coalesce(F.size(F.filter("found", lambda f: ~f["live"])), F.lit(0)).alias("n_example"), "found",
    )
