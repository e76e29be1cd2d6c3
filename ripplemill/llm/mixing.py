"""Mixing sources to target weights by capped water-filling.

Targets share ``total`` words by weight; a target above ``max_epochs`` times its source's
size stops there and the excess goes to the other sources by weight, until none is above.
A source is then taken in whole repetitions of all its documents and one fractional
repetition: documents in a seeded order, up to the words that are missing.

Null and empty texts have size 0 and are taken with their source's whole repetitions.
Null sources form one source, last in order. Repeated rows (doc_id, source and text) are
taken or left together; rows that share only the doc_id are decided one by one. If all
sources together are capped below the total, each stops at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, seed: int) -> Column:
    """Where a document stands in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def _tie(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text.cast("string").cast("binary")), F.lit(0))


def water_fill(sources: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sources`` (source, weight double, source_size long), one row each, with ``target`` added.

    Sources in order of how soon they are full (cap / weight): the first k are capped where
    k is the last whose cap lies below the level that the others then share. That needs
    running sums over one row a source, not a loop.
    """
    order = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_first())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(total_share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level if all before are capped and this and all later ones are not
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
    )
    # levels rise while capped sources are taken out and fall after, so the right one is the largest that holds
    level = F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(every)
    return out.withColumn("open", level).select("source", "weight", "source_size", F.when(F.col("open").isNull() | (F.col("fill") < F.col("open")), F.col("cap")).otherwise(F.col("weight") * F.col("open")).alias("target"))


def cycled_weights(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights given in turn to sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken, whole, place, tie) for each document.

    The seeded order of a source is by a digest of seed and doc_id. Its first hex digits
    put a source's documents into 16**digits slices, so that running sums are taken inside
    slices and over slices, never over one source in one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _tie(F.col("text")).alias("tie"))
    rows = rows.withColumn("place", _place(F.col("doc_id"), seed)).withColumn("slice", F.substring("place", 1, digits))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = water_fill(cycled_weights(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights), total_share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slices_before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    named = targets.withColumnRenamed("source", "t_source")
    slices = slices.join(named, slices["source"].eqNullSafe(named["t_source"])).drop("t_source")
    inside = Window.partitionBy("source", "slice").orderBy("place", "tie", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("source", "slice", "place", "tie", "size")
    rows = rows.withColumn("docs_upto", F.sum("size").over(inside)).withColumn("equal_rows", F.count("*").over(same))
    s = slices.withColumnsRenamed({"source": "s_source", "slice": "s_slice"})
    joined = rows.join(s, rows["source"].eqNullSafe(s["s_source"]) & (rows["slice"] == s["s_slice"])).drop("s_source", "s_slice")
    # a document (repeated rows: all of them) belongs to the fractional repetition if its middle lies below the missing words
    extra = (F.col("slices_before") + F.col("docs_upto") - F.col("equal_rows") * F.col("size") / 2 < F.col("missing")).cast("long")
    return joined.withColumn("repeats", F.col("whole") + F.when(F.col("size") > 0, extra).otherwise(0)).select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "whole", "place", "tie")


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as planned, with its own columns.

    The fractional repetition is the beginning of a source's seeded order, so all that a row
    must be held against is where its source's ends: one row a source. Texts aren't shuffled.
    """
    space = Workspace(docs.sparkSession, "mix")
    last = F.max(F.when(F.col("repeats") > F.col("whole"), F.struct("place", "tie"))).alias("last")
    ends = space.keep(plan(docs, seed=seed, **options).groupBy("source").agg(F.max("whole").alias("whole"), last).withColumnRenamed("source", "of"), "ends")
    ends = broadcast_if_small(ends, 4 * ends.count())
    # the row is one column by itself, so its own names can't clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(ends, F.col("row.source").cast("string").eqNullSafe(F.col("of")))
    at = F.struct(_place(F.col("row.doc_id").cast("long"), seed).alias("place"), _tie(F.col("row.text")).alias("tie"))
    extra = F.when(F.col("row.text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.coalesce(at <= F.col("last"), F.lit(False)).cast("int")).otherwise(0)
    rows = rows.withColumn("repeats", F.col("whole").cast("int") + extra).where("repeats > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")
