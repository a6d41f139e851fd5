"""SimHash near-dedup with pivot distance tables.

Every bit of a fingerprint is the majority over the XXH64 of all word shingles. Distinct fingerprints only are
compared; documents come back by their fingerprint. Fingerprints within `bits` differing bits share all but `bits` of
any `bits + 2` blocks, hence two blocks: each pair of blocks is a bucket key (exact, no pair is lost; three of `bits + 3`
blocks or four of `bits + 4` where there are many fingerprints, exact as well). In a bucket a
table of distances to pivot fingerprints is computed; two fingerprints whose distances to any pivot differ by more than
`bits` can't be near (triangle inequality) and are discarded, survivors are verified on the fingerprints. Buckets send
on spanning forests of their links, not the links; distributed components join them.

Null and empty texts have fingerprint zero and link like any other. Null ids take part; a component's id is its
smallest id that isn't null, null without one. Rows that repeat an id are documents of their own. A very long text is
read whole, its hashes summed in blocks. Columns of docs with names used here don't meet them. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.blocks import dealt, ends, forest, grouped, whole_groups
from inkwell.llm.common import components, materialize, utf8


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, 42)
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, to[:-1] + 1][: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(starts, to[size - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, size: int = 4) -> Column:
    """The fingerprint of a text column, as a signed long."""

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        data, starts = utf8(column)
        out = np.fromiter((_fingerprint(data[i:j].tobytes(), size) for i, j in zip(starts[:-1], starts[1:])), np.uint64, len(starts) - 1)
        return pa.array(out.view(np.int64))

    return fingerprint(text)


def _block_keys(bits: int, chosen: int) -> Column:
    """Keys of each choice of `chosen` of bits + chosen blocks of the column fp: an array of longs."""
    n = bits + chosen
    edge = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.col("fp"), edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(n)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in choice]) for k, choice in enumerate(combinations(range(n), chosen))])


def _near(bits: int, pivots: int):
    pivot = np.random.default_rng(64).integers(0, 2**64, pivots, np.uint64, endpoint=False)

    def near(batches):
        for t in whole_groups(batches):
            fp = t["fp"].to_numpy().view(np.uint64)
            key, pair, own = (t[c].to_numpy() for c in ("key", "pair", "own"))
            table = np.bitwise_count(fp[:, None] ^ pivot[None, :]).astype(np.int8)
            order = np.lexsort((table[:, 0], pair, key))
            fp, key, pair, own, table = fp[order], key[order], pair[order], own[order], table[order]
            end, two = ends(key, pair), pair >> 31 != pair & 0x7FFFFFFF
            left, right, at, step = [], [], np.arange(len(fp)), 1
            while len(at := at[at + step < end[at]]):
                at = at[table[at + step, 0] - table[at, 0] <= bits]  # in order of this distance: none further on either
                i = at[~two[at] | (own[at] != own[at + step])]
                i = i[(np.abs(table[i, 1:] - table[i + step, 1:]) <= bits).all(axis=1)]
                i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
                left.append(i)
                right.append(i + step)
                step += 1
            if left:
                root = forest(len(fp), np.concatenate(left), np.concatenate(right))
                linked = np.flatnonzero(root != np.arange(len(fp)))
                if len(linked):
                    a, b = fp.view(np.int64)[linked], fp.view(np.int64)[root[linked]]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return near


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, bits: int = 4, pivots: int = 16, block: int = 1024) -> DataFrame:
    """Rows (doc_id, fp, fingerprint, component_id) of all documents."""
    own = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), size).alias("fp")))
    return linked(own, bits, pivots, block)


def linked(own: DataFrame, bits: int = 4, pivots: int = 16, block: int = 1024, chosen: int | None = None) -> DataFrame:
    """own: doc_id, fp and others. Adds fingerprint (hex) and component_id. chosen: blocks of a key, by the number of fingerprints unless given."""
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # Two, three or four blocks of a key, as buckets of fewer would fill up. Any choice finds every pair.
    chosen = chosen or 2 + sum(classes.count() > n for n in (1 << 24, 1 << 30))
    keyed = classes.select("fp", F.explode(_block_keys(bits, chosen)).alias("key"))
    links = grouped(dealt(keyed, "fp", block).select("key", "pair", "own", "fp")).mapInArrow(_near(bits, pivots), "a long, b long")
    parts = components(links)
    named = materialize(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = materialize(named.join(least, "component").select("fp", "component_id"))
    return own.join(named, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
