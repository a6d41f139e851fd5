"""Corpus preparation: duplicates, greedy windows, pooling, pieces, stand-in documents, pairing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.tokens import WORD, let, sentences, tokens
from inkwell.sources.scratch import materialize

LEAST_DUPLICATE_WORDS = 20
WINDOW = 500
LENGTHS = (75, 150, 300)
PIECES_PER_CHUNK = 1.5
BUDGET = 30_000


def duplicates(texts: DataFrame, key: Sequence[str], text: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """texts with first (struct of order and key): the first text with the same words; null for those of under 20 words.

    A grouped minimum finds the first. Texts without a key aren't shuffled for it, and the minima are dealt anew before
    the join, so both its sides are plain shuffles and AQE splits a text copied over a third of all rows.
    """
    order = list(order) or list(key)
    words = tokens(F.col(text))
    rows = texts.withColumn("__k", let(words, lambda w: F.when(F.size(w) >= LEAST_DUPLICATE_WORDS, F.sha2(F.array_join(w, " "), 256))))
    long = rows.where("__k IS NOT NULL")
    first = long.groupBy("__k").agg(F.min(F.struct(*order)).alias("first"))
    short = rows.where("__k IS NULL").withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    return long.join(first.hint("rebalance"), "__k").unionByName(short).drop("__k")


def drop_duplicates(texts: DataFrame, key: Sequence[str], text: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """The first of each set of texts with the same words."""
    order = list(order) or list(key)
    return duplicates(texts, key, text, order).where(F.col("first").isNull() | (F.col("first") == F.struct(*order))).drop("first")


class _Packer:
    """Greedy packing of sized items to windows, one after the other.

    A window closes at `words`, or early rather than pass one and a half times that; a rest under half joins the last.
    """

    def __init__(self, words: int):
        self.words, self.window, self.size = words, 0, 0
        self.filled = False  # the open window holds an item

    def put(self, n: int, glued: bool = False, glue_next: bool = False) -> int:
        """The window of the next item; glued: it stays with the item before."""
        if self.filled and not glued and 2 * self.size >= self.words and self.size + n > 1.5 * self.words:
            self.window, self.size = self.window + 1, 0
        own = self.window
        self.size, self.filled = self.size + n, True
        if self.size >= self.words and not glue_next:
            self.window, self.size, self.filled = self.window + 1, 0, False
        return own

    def rest(self) -> int | None:
        """The window that is too small to stand alone at the end, if there is one."""
        return self.window if self.filled and self.window and 2 * self.size < self.words else None


def packed(sizes: Column, words: int = WINDOW, glued: Column | None = None) -> Column:
    """The window number (from 0) of each item of an array of word counts, greedily packed in order.

    glued: an array of booleans, items that stay with the item before them.
    """

    @F.arrow_udf("array<int>")
    def at(column: pa.Array, stick: pa.Array) -> pa.Array:
        out = []
        for ns, gs in zip(column.to_pylist(), stick.to_pylist()):
            gs, packer = gs or [False] * len(ns), _Packer(words)
            own = [packer.put(n, g, after) for n, g, after in zip(ns, gs, [*gs[1:], False])]
            rest = packer.rest()
            out.append([w - (w == rest) for w in own])
        return pa.array(out, pa.list_(pa.int32()))

    none = F.array().cast("array<boolean>")
    return at(F.coalesce(sizes.cast("array<int>"), F.array().cast("array<int>")), none if glued is None else F.coalesce(glued, none))


def pieces(prep: DataFrame, words: int = WINDOW) -> DataFrame:
    """Prepared chunks with pieces (array of struct(text, n, block)): blocks, those over one and a half windows cut at sentences."""
    count = lambda t: F.regexp_count(t, F.lit(WORD))
    one = lambda b, i: F.when(count(b) > words * 1.5, F.transform(sentences(b), lambda s: F.struct(s.alias("text"), count(s).alias("n"), i.alias("block")))).otherwise(F.array(F.struct(b.alias("text"), count(b).alias("n"), i.alias("block"))))
    return prep.withColumn("pieces", F.flatten(F.transform("prose.blocks", one)))


def windows(prep: DataFrame, words: int = WINDOW, keep: Sequence[str] = ("chunk_id", "document")) -> DataFrame:
    """(keep, window, n, text): chunks cut into windows of about so many words."""
    cut = pieces(prep, words).withColumn("at", packed(F.transform("pieces", lambda p: p["n"]), words))
    each = cut.select(*keep, F.posexplode(F.arrays_zip("pieces", "at")).alias("pos", "x")).select(*keep, "pos", F.col("x.at").alias("window"), "x.pieces.*")
    run = Window.partitionBy(*keep, "window").orderBy("pos")
    each = each.withColumn("lead", F.when(F.lag("block").over(run).isNull(), "").when(F.lag("block").over(run) == F.col("block"), " ").otherwise("\n\n"))
    parts = each.groupBy(*keep, "window").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.concat("lead", "text").alias("t")))).alias("p"))
    return parts.select(*keep, "window", "n", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def _windowed(words: int):
    """Sorted rows (g, n and others) with window; only rows of the open window are kept back, as they may join the one before."""

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, kept = None, _Packer(words), []  # kept: slices of batches and their window

        def sent(last: bool) -> Iterator[pa.RecordBatch]:
            rest = packer.rest() if last else None
            while kept and (last or kept[0][1] != packer.window):
                rows, window = kept.pop(0)
                yield rows.append_column(pa.field("window", pa.int32()), pa.array(np.full(rows.num_rows, window - (window == rest), np.int32)))

        for batch in batches:
            sizes, groups = batch.column(batch.schema.get_field_index("n")).to_pylist(), batch.column(batch.schema.get_field_index("g")).to_pylist()
            own = []
            for i, (n, g) in enumerate(zip(sizes, groups)):
                if g != group:
                    if own:
                        kept += _runs(batch, own, i)
                        own = []
                    yield from sent(True)
                    group, packer = g, _Packer(words)
                own.append(packer.put(n))
            if own:
                kept += _runs(batch, own, len(sizes))
            yield from sent(False)
        yield from sent(True)

    return windowed


def _runs(batch: pa.RecordBatch, own: list[int], end: int) -> list[tuple[pa.RecordBatch, int]]:
    """Slices of equal windows of the rows before `end` that `own` has windows for."""
    edge = np.flatnonzero(np.diff(np.r_[-1, own, -1]))
    return [(batch.slice(end - len(own) + int(i), int(j - i)), own[i]) for i, j in zip(edge[:-1], edge[1:])]


def pool(records: DataFrame, group: Sequence[str], order: str, text: str = "text", words: int = WINDOW) -> DataFrame:
    """(group, window, n, texts, text): short records of a group joined in order to windows.

    Word counts and orders alone are sorted by group and streamed through the packer, so a group of any size is a stream
    of small rows, never a row; its texts are spread over its windows. Null groups are one group. Records of one group
    and order come in the order they are read in.
    """
    counted = records.withColumn("n", F.regexp_count(F.col(text), F.lit(WORD)).cast("long")).where("n > 0")
    held = materialize(counted.withColumn("__row", F.monotonically_increasing_id()))
    keys = held.select(F.to_json(F.struct(*group)).alias("g"), F.col(order).alias("o"), "n", "__row").repartition("g").sortWithinPartitions("g", "o", "__row")
    spots = keys.select("g", "n", "__row").mapInArrow(_windowed(words), "g string, n long, __row long, window int").select("__row", "window")
    joined = held.join(spots, "__row")
    parts = joined.groupBy(*group, "window").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("p"))
    return parts.select(*group, "window", "n", "texts", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def pools_by_default(prep: DataFrame, words: int = WINDOW) -> DataFrame:
    """One row: the median words of texts, and whether that is under a quarter of a window."""
    return prep.agg(F.median("n").alias("median_words")).withColumn("pool", F.col("median_words") < words / 4)


def every_kth(rows: DataFrame, order: Sequence[str], size: str, budget: int = BUDGET, by: Sequence[str] = ()) -> DataFrame:
    """A systematic sample: every k-th row in order, k the least that keeps `size` within a budget. Adds k.

    Places are prefix counts in two levels, over range buckets of the order and inside each, so no task orders all rows.
    The buckets are written out once: their bounds are sampled, and a second evaluation would cut elsewhere. So are the rows
    before, which the size, the bounds and the buckets read.
    """
    rows = materialize(rows)
    k = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / budget)).cast("long").alias("k"))
    ranged = materialize(rows.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    before = before.join(k, list(by)) if by else before.crossJoin(F.broadcast(k))  # one row
    here = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)) - 1
    return ranged.withColumn("__r", here).join(before, [*by, "__p"]).where((F.col("__r") + F.col("__b")) % F.col("k") == 0).drop("__r", "__b", "__p")


def stand_ins(windowed: DataFrame, document: str, order: str, groups: int = 8) -> DataFrame:
    """Windows of a document that can't be split, with stand_in (from 0): near-equal runs with edges at round(i * n / groups).

    Places in a document are prefix counts over range buckets, so a document with a third of all rows isn't one task.
    """
    ranged = materialize(windowed.repartitionByRange(document, order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy(document, "__p").agg(F.count("*").alias("__c"))
    every = Window.partitionBy(document)
    before = counts.select(document, "__p", F.sum("__c").over(every).alias("__n"), F.coalesce(F.sum("__c").over(every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = F.row_number().over(Window.partitionBy(document, "__p").orderBy(order)) - 1 + F.col("__b")
    g = F.least(F.lit(groups), F.col("__n")).cast("int")
    edges = F.transform(F.sequence(F.lit(1), g), lambda i: F.bround(i * F.col("__n") / g).cast("long"))
    before = before.withColumnsRenamed({document: "__d", "__p": "__q"})
    placed = ranged.join(before, F.col(document).eqNullSafe(F.col("__d")) & (F.col("__p") == F.col("__q"))).withColumn("__at", at)
    return placed.withColumn("stand_in", F.size(F.filter(edges, lambda e: e <= F.col("__at")))).select(*windowed.columns, "stand_in")


def group_quality(records: DataFrame, group: str, text: str = "text") -> DataFrame:
    """One row: records, groups, records without a group, median words a group."""
    own = records.select(F.col(group).alias("g"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).alias("n"))
    per = own.where("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    missing = own.agg(F.count_if(F.col("g").isNull()).alias("without_group"))
    return per.agg(F.sum("c").alias("records"), F.count("*").alias("groups"), F.median("n").alias("median_group_words")).crossJoin(missing)


def paired(edits: DataFrame, originals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edits with original: matched by the first key, then the next for those unmatched; a key pairs only where unique.

    Both sides have id and the key columns.
    """
    left, done = edits, None
    for key in keys:
        once = originals.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("original"), F.count("*").alias("c")).where("c = 1").drop("c")
        got = left.join(once, key, "left")
        hit = got.where("original IS NOT NULL").select("id", "original", F.lit(key).alias("by"))
        done = hit if done is None else done.unionByName(hit)
        left = got.where("original IS NULL").select(*edits.columns)
    return done.unionByName(left.select("id", F.lit(None).cast(dict(originals.dtypes)["id"]).alias("original"), F.lit(None).cast("string").alias("by")))


def _held_times(a: Column, some: Column) -> Column:
    """How many elements of an array of longs, repeats and all, are among `some` of its different ones: among both twice and
    `some`, sorted, these come an odd number of times."""
    half = lambda run: F.when(run % 2 == 1, F.shiftright(run, 1)).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        same = (s["run"] > 0) & (s["last"] == x)
        return F.struct(x.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["total"]).otherwise(s["total"] + half(s["run"])).alias("total"))

    return F.aggregate(F.sort_array(F.concat(a, a, some)), start, step, lambda s: s["total"] + half(s["run"]))


def ngram_changed(pairs: DataFrame, old: str = "old", new: str = "new", n: int = 13, key: str = "pair") -> DataFrame:
    """(key, grams, changed): share of the original's n-word sequences that its edit doesn't have; repeats count.

    A pair is compared in its row, so no task holds the sequences of many. Rows of one key are one pair: their sequences
    are grouped.
    """
    def grams(c: str) -> Column:
        hashed = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, n)))
        return let(tokens(F.col(c)), lambda t: F.when(F.size(t) >= n, hashed(t)).otherwise(F.array().cast("array<long>")))

    def compared(a: Column, b: Column) -> Column:
        size = F.size(a)
        gone = lambda g: F.when((F.size(g) == 0) | (F.size(g) == size), F.size(g)).when(F.size(F.array_distinct(a)) == size, F.size(g)).otherwise(_held_times(a, g))
        told = F.struct(size.cast("long").alias("grams"), (let(F.array_except(a, b), gone) / size).alias("changed"))
        return F.when(size > 0, told)

    rows = pairs.select(key, F.col(old).alias("__old"), F.col(new).alias("__new"), F.count("*").over(Window.partitionBy(key)).alias("__rows"))
    known = F.col(key).isNotNull()
    own = let(grams("__old"), lambda a: let(grams("__new"), lambda b: compared(a, b)))
    single = rows.where(~known | (F.col("__rows") == 1)).select(key, F.when(known, own).alias("__c")).select(key, "__c.*")
    tagged = lambda c, is_old: F.transform(grams(c), lambda g: F.struct(g.alias("g"), F.lit(int(is_old)).alias("a"), F.lit(int(not is_old)).alias("b"), F.lit(0).alias("rows")))
    one = F.array(F.struct(F.lit(None).cast("long").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("rows")))
    each = rows.where(known & (F.col("__rows") > 1)).select(key, F.explode(F.concat(one, tagged("__old", True), tagged("__new", False))).alias("x")).select(key, "x.*")
    each = each.groupBy(key, "g").agg(F.sum("a").alias("a"), F.max("b").alias("b"), F.sum("rows").alias("rows"))
    many = each.groupBy(key).agg(F.sum("a").alias("grams"), F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("gone"), F.sum("rows").alias("rows"))
    many = many.select(key, F.when(F.col("grams") > 0, F.col("grams")).alias("grams"), F.when(F.col("grams") > 0, F.col("gone") / F.col("grams")).alias("changed"), F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")
    return single.unionByName(many)
