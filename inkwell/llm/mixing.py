"""Mixing sources to target weights: Efraimidis-Spirakis keys scaled by quality, prefix sums to token budgets.

A source's target is its weighted share of all words, at most `most_epochs` times its own words; the excess is shared
again by weight. Complete epochs come first; the rest of the budget is a weighted sample without replacement: documents
in order of -ln(u)/quality, u from a hash of id and text, until the budget is met (the crossing document is taken if that
comes nearer).

No source is sorted in one task: documents are summed by digits of their key (a radix of 4096), and only the rows of the
one digit where the budget runs out are looked at closer, twice, before the rest are ordered.

Null and empty texts have size 0 and take nothing; null sources are one source, last. Null and repeated ids are
documents of their own. Rows that repeat id and text tie: they count as one row with a number of copies, and where the
budget runs out among them, as many copies are taken as come nearest to it (which ones can't be told apart). A very long
text is counted whole in the scan. Columns of docs with names used here don't meet them. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, materialize

RADIX = 4096
#: Copies of one row written by one task at most, where a group of copies is taken in part.
BLOCK = 1 << 16


def quality(text: Column) -> Column:
    """0.05 to 1: falls with the share of a text's characters that are marks found in junk and markup."""
    plain = F.translate(text, "*$%&#|!<>{}[]\\^~", "")
    return F.greatest(F.lit(0.05), 1 - 4 * (1 - F.length(plain) / F.greatest(F.length(text), F.lit(1))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target. Weights go to sources by code point, null last, repeating."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    own = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most_epochs))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = own.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # Sources whose cap is under the level of those from it on are full; the first level that fits is that of the rest.
    found = level.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, epochs) of all documents; taken counts words, repeats included.

    weight: a document's quality, above 0; quality(text) unless given.
    """
    body, name = F.coalesce(F.col(text), F.lit("")), F.col(source)
    good = quality(body) if weight is None else weight
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), name.alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), body)).alias("tie"), good.alias("good"),
    )
    u = (F.conv(F.substring("tie", 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k"), "size", "tie", (-F.log(u) / F.col("good")).alias("key"))
    spread = (1 - F.exp(-F.col("key"))) * RADIX
    rows = materialize(rows.withColumns({"d1": F.floor(spread), "d2": F.floor((spread - F.floor(spread)) * RADIX)}))

    sums = rows.groupBy("k").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(F.col("k") != "n", F.substring("k", 2, 1 << 30)))
    goals = source_targets(sums.select("source", "source_size"), weights, most_epochs).withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
    goals = materialize(goals.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))))

    run = Window.partitionBy("k").orderBy("d")
    meets = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") >= F.col("rest"))
    first = rows.groupBy("k", F.col("d1").alias("d")).agg(F.sum("size").alias("s")).withColumn("before", F.sum("s").over(run) - F.col("s"))
    first = materialize(first.join(goals, "k").where(meets).select("k", F.col("d").alias("e1"), F.col("before").alias("b1"), "rest"))
    second = rows.join(first, "k").where("d1 = e1").groupBy("k", F.col("d2").alias("d")).agg(F.sum("size").alias("s"), F.first("e1").alias("e1"), F.first("b1").alias("b1"), F.first("rest").alias("rest"))
    second = materialize(second.withColumn("before", F.col("b1") + F.sum("s").over(run) - F.col("s")).where(meets).select("k", "e1", F.col("d").alias("e2"), F.col("before").alias("b2"), "rest"))
    # Rows alike in key and tie are one group of c copies; m of them fit.
    ordered = Window.partitionBy("k").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    third = rows.join(second, "k").where("d1 = e1 AND d2 = e2").groupBy("k", "key", "tie").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("doc_id", "size", "b2", "rest")])
    third = third.withColumn("before", F.col("b2") + F.sum(F.col("c") * F.col("size")).over(ordered) - F.col("c") * F.col("size"))
    fits = F.when(F.col("size") > 0, F.least("c", F.floor((F.col("rest") - F.col("before") - F.col("size") / 2) / F.col("size")) + 1)).otherwise(F.col("c"))
    cut = third.where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("k").agg(F.max(F.struct("key", "tie", "c", fits.alias("m"), "doc_id", "size")).alias("cut"))
    plan = materialize(goals.join(second.select("k", "e1", "e2"), "k", "left").join(cut, "k", "left"))

    last = F.coalesce((F.col("key") == F.col("cut.key")) & (F.col("tie") == F.col("cut.tie")), F.lit(False))
    ahead = (F.col("key") < F.col("cut.key")) | ((F.col("key") == F.col("cut.key")) & (F.col("tie") <= F.col("cut.tie")))
    within = (F.col("d1") < F.col("e1")) | ((F.col("d1") == F.col("e1")) & ((F.col("d2") < F.col("e2")) | ((F.col("d2") == F.col("e2")) & ahead)))
    whole = rows.join(plan, "k").where(~(last & (F.col("cut.m") < F.col("cut.c")))).withColumn("more", F.coalesce(within, F.lit(False)))
    # A group that is taken in part: its copies are written anew, in blocks, as nothing tells one from another.
    parted = plan.where("cut.m < cut.c").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("cut.c") - 1) / BLOCK))).alias("block")).repartition("k", "block")
    parted = parted.withColumn("at", F.explode(F.sequence(F.col("block") * BLOCK, F.least("cut.c", (F.col("block") + 1) * BLOCK) - 1))).withColumn("more", F.col("at") < F.col("cut.m"))
    fields = ("source_size", "target", "epochs", "more")
    every = whole.select("doc_id", "size", *fields).unionByName(parted.select("cut.doc_id", "cut.size", *fields))
    copies = F.col("epochs") + F.col("more").cast("int")
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("epochs"))
