"""Removal of repeated byte strings: every byte covered by a string of `span` bytes that also starts anywhere else.

suffix_array and repeated_runs are the method on one machine: a bottom-up mergesort of suffixes whose comparisons find
the common extension by binary search over prefix polynomial hashes, with a byte comparison of what the hashes call equal.

A corpus isn't sorted as a whole: one suffix a byte, times a merge's passes, is many times the corpus in shuffles. The
distributed form sends each string to its equals by content instead. A window (a string of `span` bytes) has an anchor,
the position of the least hashed k-gram in it, which equal windows share. Windows are compared in nodes at three levels,
all windows of an anchor, those whose anchor is at one of `step` neighbouring offsets, and single windows. A node has a
core, the bytes common to all its windows, and a union, the bytes of all of them. A union met twice: all its windows
repeat. A core met once: none does. A core with several unions goes down one level. So the edges of repeated passages
are found by a search over extension lengths, and only they cost more than a row an anchor.

Cores are prefix polynomial hashes, unions are in addition XXH3 of the bytes themselves: a decision needs both to agree.
Only whether a core may repeat is broadcast, as a bitmap of fixed size; its false positives cost time alone.

Null and empty texts are empty. A text shorter than `span` loses nothing. Strings are judged on the input. Each row is a
document, also one that repeats an id or has none; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize, slices, utf8

KGRAM, STEP = 40, 8
BITMAP_BITS = 27
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 36) - 1)


class Powers:
    """Powers of the base and of its inverse, as long as asked for, and the values of bytes."""

    def __init__(self):
        self.values = np.random.default_rng(40).integers(0, 2**64, 256, np.uint64, endpoint=False)
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b))], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up[:n], self.down[: n + 1]


class Prefixes:
    """Prefix polynomial hashes of bytes, modulo 2**64: the hash of any range by two lookups."""

    def __init__(self, data: np.ndarray, powers: Powers | None = None):
        powers = powers or Powers()
        up, self.inverse = powers.to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(powers.values[data] * up, out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[j] - self.sums[i]) * self.inverse[i]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x7FB5D329728EA185)
            return h ^ (h >> np.uint64(29))


def common_extension(prefixes: Prefixes, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at i and j, by binary search."""
    low, high = np.zeros(len(i), np.int64), n - np.maximum(i, j)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = prefixes.of(i, i + mid) == prefixes.of(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of one string in order: mergesort, each pass of merges done at once by ranks in the other run."""
    n = len(data)
    prefixes, order, width = Prefixes(data), np.arange(n), 1

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = common_extension(prefixes, i, j, n)
        end = np.maximum(i, j) + k >= n
        a, b = np.minimum(i + k, n - 1), np.minimum(j + k, n - 1)
        if not end.all() and (data[a][~end] == data[b][~end]).any():
            raise ValueError("two strings with one hash")
        return np.where(end, i > j, data[a] < data[b])

    while width < n:
        at = np.arange(n)
        start = at // (2 * width) * (2 * width)
        first = at < start + width
        low = np.where(first, np.minimum(start + width, n), start)
        high = np.where(first, np.minimum(start + 2 * width, n), np.minimum(start + width, n))
        base = low.copy()
        while (open_ := low < high).any():  # ranks in the other run
            mid = (low + high) // 2
            m = np.minimum(mid, n - 1)
            before = less(order[m], order)
            low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
        merged = np.empty_like(order)
        merged[start + (at - start - np.where(first, 0, width)) + (low - base)] = order
        order, width = merged, 2 * width
    return order


def repeated_runs(data: np.ndarray, starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Ranges of bytes to remove from documents held back to back, on one machine, by a suffix array."""
    order = suffix_array(data)
    whole = np.zeros(len(data), bool)
    for i, j in zip(starts[:-1], starts[1:]):
        whole[i : max(i, j - span + 1)] = True
    order = order[whole[order]]
    found = []
    for a, b in zip(order[:-1], order[1:]):
        if bytes(data[a : a + span]) == bytes(data[b : b + span]):
            found += [a, b]
    return _merged(np.unique(np.array(found, np.int64)), span)


def _merged(windows: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal byte runs of ascending window starts."""
    if not len(windows):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(windows) > span, True])
    return [(int(windows[i]), int(windows[j - 1]) + span) for i, j in zip(new[:-1], new[1:])]


def anchors(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents back to back: anchors, and the first and last window that each has.

    A window's anchor is the first of the positions in it whose k-gram has the least value, a hash of its first 8 bytes.
    """
    n = len(data)
    width, grams = span - KGRAM + 1, n - KGRAM + 1
    count = n - span + 1
    if count <= 0:
        return (np.empty(0, np.int64),) * 3
    eight = np.ndarray((grams,), "<u8", np.ascontiguousarray(data), 0, (1,))
    table = np.full(-(-grams // width) * width, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply(eight, np.uint64(_BASE), out=table[:grams])
    table[:grams] &= ~_POSITION
    table[:grams] |= np.arange(grams, dtype=np.uint64)
    table = table.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _POSITION).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(starts) >= span)
    valid[starts[long]] = 1
    valid[starts[long + 1] - span + 1] -= 1
    s = np.flatnonzero(np.cumsum(valid[:count], dtype=np.int8))
    if not len(s):
        return (np.empty(0, np.int64),) * 3
    own = least[s]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)])
    return own[new], s[new], s[np.r_[new[1:], len(s)] - 1]


def _held(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    bit = codes >> np.uint64(65 - (64 * len(bitmap)).bit_length())
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _folded(bitmap: np.ndarray) -> np.ndarray:
    """The same set in as few bits as leave one of 64 set or less, 2**12 at least: what few hashes need isn't sent as 16 MB."""
    bits, most = (64 * len(bitmap)).bit_length() - 1, 64 * int(np.bitwise_count(bitmap).sum())
    fewer = max(12, most.bit_length())
    if fewer >= bits:
        return bitmap
    word = np.flatnonzero(bitmap)
    row, at = np.nonzero(np.unpackbits(bitmap[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    place = (word[row] * 64 + at) >> (bits - fewer)
    out = np.zeros(1 << fewer - 6, np.uint64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of low..high, row by row."""
    n = high - low + 1
    row = np.repeat(np.arange(len(low)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _nodes(data: np.ndarray, starts: np.ndarray, marks: np.ndarray, span: int, level: int, wanted: list[tuple[np.ndarray, np.ndarray]], powers: Powers):
    """Core, key, first and last window, document and seed of the union's hash of a level's nodes.

    wanted: for the levels above, bitmaps of the cores and the keys to go into; before level 0, of cores alone. A key
    tells a node from those with the same core and union.
    """

    def keyed(core, first, doc):
        with np.errstate(over="ignore"):
            k = core + marks[doc] * np.uint64(0xD6E8FEB86659FD93) + (first - starts[doc]).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            k ^= k >> np.uint64(32)
            return k * np.uint64(0xE7037ED1A0B428DB)

    a, first, last = anchors(data, starts, span)
    prefixes = Prefixes(data, powers)
    core = prefixes.of(a, a + KGRAM)
    if wanted:
        keep = _held(wanted[0][0], core)
        a, first, last, core = a[keep], first[keep], last[keep], core[keep]
    doc = np.searchsorted(starts, first, "right") - 1
    key = keyed(core, first, doc)
    if level <= 0:
        return core, key, first, last, doc, (a - first) * 4096 + (a - last)
    keep = _held(wanted[1][0], core)
    keep[keep] = _held(wanted[1][1], key[keep])
    a, first, last, doc = a[keep], first[keep], last[keep], doc[keep]
    row, block = _spread((a - last) // STEP, (a - first) // STEP)
    a, doc, near, far = a[row], doc[row], np.maximum(block * STEP, (a - last)[row]), np.minimum(block * STEP + STEP - 1, (a - first)[row])
    first, last = a - far, a - near
    core = prefixes.of(a - block * STEP, a - block * STEP - STEP + 1 + span)
    key = keyed(core, first, doc)
    if level == 1:
        return core, key, first, last, doc, far * 4096 + near
    keep = _held(wanted[2][0], core)
    keep[keep] = _held(wanted[2][1], key[keep])
    row, first = _spread(first[keep], last[keep])
    doc = doc[keep][row]
    core = prefixes.of(first, first + span)
    return core, keyed(core, first, doc), first, first, doc, np.zeros(len(first), np.int64)


def _emitted(span: int, level: int, shared: list):
    """Nodes of a level; before level 0 (-1) the cores of all anchors alone."""

    def emitted(batches):
        wanted = [tuple(b and b.value for b in pair) for pair in shared]
        digest, powers = xxhash.xxh3_64_intdigest, Powers()
        for b in batches:
            data, starts = utf8(b.column(b.schema.get_field_index("text")))
            ids, mark = b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("mark"))
            marks = mark.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in slices(starts, 1 << 17):
                own = starts[i : j + 1] - starts[i]
                part = data[starts[i] : starts[j]]
                core, key, first, last, doc, seed = _nodes(part, own, marks[i:j], span, level, wanted, powers)
                if not len(core):
                    continue
                if level < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], ["core"])
                    continue
                raw = part.tobytes()
                whole = np.fromiter([digest(raw[x:y], s) for x, y, s in zip(first.tolist(), (last + span).tolist(), seed.tolist())], np.uint64, len(core))
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (core, whole, key)), ids.take(take), mark.take(take), pa.array(first - own[doc]), pa.array(last - own[doc])], ["core", "whole", "key", "id", "mark", "first", "last"])

    return emitted


def _bitmap(hashes: DataFrame):
    """A column h of hashes as a broadcast bitmap of 2**BITMAP_BITS bits, or fewer where they are few."""
    low = 64 - BITMAP_BITS
    words = hashes.select(F.shiftrightunsigned("h", low + 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {low}) & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(_folded(bitmap))


def repeated_windows(docs: DataFrame, span: int = 200) -> DataFrame:
    """docs: id, mark, text. Rows (id, mark, first, last): ranges of starts of windows that also start elsewhere."""
    kind = dict(docs.dtypes)["id"]
    text = docs.select("id", "mark", "text")
    counts = text.mapInArrow(_emitted(span, -1, []), "core long").groupBy("core").agg(F.count("*").alias("n"))
    wanted, found = [(_bitmap(counts.where("n > 1").select(F.col("core").alias("h"))), None)], []
    for level in range(3):
        nodes = materialize(text.mapInArrow(_emitted(span, level, wanted), f"core long, whole long, key long, id {kind}, mark long, first long, last long"))
        # Written out, so that a join with it is between plain shuffles and AQE splits a union that a third of all nodes have.
        met = materialize(nodes.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min("key").alias("key")))
        if level < 2:
            # Of a core with several unions, one node of each union goes down a level.
            several = met.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
            wanted = wanted + [(_bitmap(several.select(F.col("core").alias("h"))), _bitmap(met.join(several, "core", "left_semi").select(F.col("key").alias("h"))))]
        found.append(materialize(nodes.join(met.where("n > 1").select("core", "whole"), ["core", "whole"]).select("id", "mark", "first", "last")))
        discard(nodes, met)
    return found[0].union(found[1]).union(found[2])


def _cut(span: int):
    def cut(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            data, starts = utf8(texts)
            spans = b.column(b.schema.get_field_index("spans"))
            out = []
            for k in range(b.num_rows):
                own = data[starts[k] : starts[k + 1]]
                runs = spans[k].as_py() or []
                removed = np.zeros(len(own) + 1, np.int32)
                for r in runs:
                    removed[r["first"]] += 1
                    removed[r["last"] + span] -= 1
                gone = np.cumsum(removed[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, edge.reshape(-1, 2).tolist()))
            n_bytes, n_removed, n_spans, sha, kept, ranges = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()), pa.array(ranges, pa.list_(pa.list_(pa.int64())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "ranges"])

    return cut


def dedup(docs: DataFrame, span: int = 200, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, ranges) of all documents; kept are the remaining bytes
    (a cut may fall inside a character), ranges the removed [start, end) in bytes."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_windows(rows, span).groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = materialize(spans).withColumnsRenamed({"id": "i", "mark": "m"})
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select("id", "text", "spans")
    kind = dict(rows.dtypes)["id"]
    out = joined.mapInArrow(_cut(span), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, ranges array<array<long>>")
    return out.withColumnRenamed("id", "doc_id")
