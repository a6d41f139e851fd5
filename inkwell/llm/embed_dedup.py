"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, distributed components.

Equal vectors (two hashes of 64 bits) are one class. A class has a key in each table, the signs of `planes` random projections; classes that
share a key are compared by cosine in double precision. The number of planes follows the number of classes so that a
bucket keeps a size of about `bucket`, and the number of tables follows from the planes so that a pair at exactly the
threshold is missed with a chance of `missed` at most. A pair that meets in several tables counts in the first.
Buckets send on a spanning forest and each class's number of links, never the pairs.

Null vectors, null ids, zero vectors and those with null or non-finite components link with nothing: n_links 0 and a
component of their own. Vectors of different lengths don't link. Each row is a vector, also one that repeats an id. A very
long vector is a row like any other. Other columns, of whatever names, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.blocks import dealt, forest, grouped, whole_groups
from inkwell.llm.common import components, materialize


@lru_cache(4)
def _projections(planes: int, tables: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables * planes, dim))


def _keys(vectors: np.ndarray, planes: int, tables: int, seed: int, used: int | None = None) -> np.ndarray:
    """A row of table keys for each vector, for all tables or the first `used` of them."""
    used = tables if used is None else used
    signs = (vectors @ _projections(planes, tables, vectors.shape[1], seed)[: used * planes].T >= 0).reshape(len(vectors), used, planes)
    return signs @ (1 << np.arange(planes, dtype=np.int64))


def _arrays(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _signed(planes: int, tables: int, seed: int):
    def signed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column(b.schema.get_field_index("dim")))
            for dim in np.unique(n):
                own = b.filter(pa.array(n == dim))
                keys = _keys(_arrays(own.column(own.schema.get_field_index("e"))), planes, tables, seed)
                yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in ("cid", "n", "e", "dim")), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "n", "e", "dim", "signs"])

    return signed


def _verified(planes: int, tables: int, seed: int, least: float):
    def linked(vectors: np.ndarray, at: int, n: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of links of a group's vectors, and their least indexes in a forest of the links."""
        size = len(vectors)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        links, left, right = np.zeros(size, np.int64), [], []
        for a in range(0, size, 256):
            x, y = np.nonzero(unit[a : a + 256] @ unit[a:].T >= least)
            x, y = x[y > x] + a, y[y > x] + a
            if own is not None:
                x, y = x[own[x] != own[y]], y[own[x] != own[y]]
            if at and len(x):  # pairs that met in an earlier table count there; only vectors with links are projected again
                some, place = np.unique(np.r_[x, y], return_inverse=True)
                signs = _keys(vectors[some], planes, tables, seed, at)
                i, j = place[: len(x)], place[len(x) :]
                new = np.ones(len(x), bool)
                for earlier in range(at):
                    new &= signs[i, earlier] != signs[j, earlier]
                x, y = x[new], y[new]
            if len(x):  # a tile's links shrink to a forest before the next tile
                links += np.bincount(x, n[y], size).astype(np.int64) + np.bincount(y, n[x], size).astype(np.int64)
                root = forest(size, x, y)
                held = np.flatnonzero(root != np.arange(size))
                left.append(held)
                right.append(root[held])
        return links, forest(size, np.concatenate(left), np.concatenate(right)) if left else np.arange(size)

    def verified(batches):
        for t in whole_groups(batches, 4096):
            # Keys are hashes of table, length and signs: what shares one by chance is told apart here.
            t = t.sort_by([(c, "ascending") for c in ("key", "pair", "dim", "at")])
            key, pair, dim, at, own, cid, n = (t[c].to_numpy() for c in ("key", "pair", "dim", "at", "own", "cid", "n"))
            new = np.zeros(len(key) + 1, bool)
            new[[0, -1]] = True
            for c in (key, pair, dim, at):
                new[1:-1] |= c[1:] != c[:-1]
            cut = np.flatnonzero(new)
            for i, j in zip(cut[:-1], cut[1:]):
                if j - i < 2:
                    continue
                two = (pair[i] >> 31) != (pair[i] & 0x7FFFFFFF)
                links, root = linked(_arrays(t["e"].slice(i, j - i)), int(at[i]), n[i:j], own[i:j] if two else None)
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(cid[i + some]), pa.array(links[some]), pa.array(cid[i + root[some]])], ["cid", "links", "root"])

    return verified


def near_duplicates(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", bucket: int = 2048, missed: float = 0.002, seed: int = 5, block: int = 2048, planes: int | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all vectors. planes: as many as the number of classes asks for unless given."""
    wide = F.col(embedding).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col(vec_id).isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))
    # Equal vectors are told by two independent hashes of 64 bits.
    mark = F.when(good, F.struct(F.xxhash64(embedding).alias("a"), F.xxhash64(F.lit("second"), F.col(embedding)).alias("b")))
    own = vectors.select(F.col(vec_id).alias("vec_id"), mark.alias("mark"), F.when(good, F.col(embedding)).alias("e"))
    classes = own.where("mark IS NOT NULL").groupBy("mark").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("e").alias("e"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    planes = planes or max(2, min(40, math.floor(math.log2(max(1, classes.count()) / bucket)) + 1))
    same = (1 - math.acos(least) / math.pi) ** planes
    tables = math.ceil(math.log(missed) / math.log1p(-same))
    kind = dict(classes.dtypes)["e"]
    signed = classes.select("cid", "n", "e", F.size("e").alias("dim")).mapInArrow(_signed(planes, tables, seed), f"cid long, n long, e {kind}, dim int, signs array<long>")
    keyed = signed.select("cid", "n", "e", "dim", F.posexplode("signs").alias("at", "sign")).withColumn("key", F.xxhash64("at", "dim", "sign")).drop("sign")
    found = materialize(grouped(dealt(keyed, "cid", block)).select("key", "pair", "own", "cid", "n", "e", "dim", "at").mapInArrow(_verified(planes, tables, seed, least), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("mark", "cid", "first", "n").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialize(named)
    low = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = named.join(low, "component").select("mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = own.where("mark IS NOT NULL").select("vec_id", "mark").join(named, "mark")
    out = linked.select("vec_id", "n_links", "component_id").unionByName(own.where("mark IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id")))
    out = out.withColumn("n_links", F.col("n_links").cast("long"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
