"""Preference formatting: pairs of a chosen and a rejected conversation as prompt and completions.

The longest common prefix of turns (same role, same text) is rendered once as the prompt;
what follows on either side is rendered as its completion, with the spans of characters
that carry loss: the texts of assistant turns. One shuffle by pair; everything else is
expressions on the pair's own turns. A pair's turns meet in one task, because its output is
one row; only a conversation too long for a row is too long for this.

Null texts count as empty, null roles as "unknown". Turns with equal numbers are ordered by
role and text, null numbers come first. A pair with one side only has no prompt and null
for the other completion. If one side is a prefix of the other its completion is empty.
Repeated rows are repeated turns. Rows with a null pair or side are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("<|end|>\n"))))


def _spans(turns: Column, before: Column) -> Column:
    """[start, end) characters of the texts with loss, in the rendered turns after the first ``before`` characters."""
    end = lambda t: (t["upto"] - F.lit(len("<|end|>\n")) - before).cast("int")
    return F.transform(F.filter(turns, lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct((end(t) - F.length(t["text"])).alias("start"), end(t).alias("end")))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side 'chosen' or 'rejected', turn, role, text) to one row a pair:
    pair_id, n_common, prompt, chosen, chosen_loss, rejected, rejected_loss."""
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # where each turn's rendering ends: summed row by row, so that long conversations cost no more a turn than short ones
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("pair_id").withColumn("upto", F.sum(F.length(F.concat(_head({"role": F.col("role")}), "text", F.lit("<|end|>\n")))).over(order))
    turn = F.struct("turn", "role", "text", "upto")
    sides = rows.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")])
    both = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    common = F.coalesce(F.array_position(both, False), F.lit(0))
    sides = sides.withColumn("n_common", F.when(common > 0, common - 1).otherwise(F.size("chosen")).cast("int"))
    # a pair with one side has no turns in common
    sides = sides.withColumn("n_common", F.when((F.size("chosen") == 0) | (F.size("rejected") == 0), 0).otherwise(F.col("n_common")))
    rest = {s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("chosen", "rejected")}
    sides = sides.withColumn("before", F.when(F.col("n_common") > 0, F.try_element_at("chosen", F.col("n_common"))["upto"]).otherwise(0))
    return sides.select(
        "pair_id",
        "n_common",
        _rendered(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"),
        *[c for s in rest for c in (F.when(F.size(s) > 0, _rendered(rest[s])).alias(s), F.when(F.size(s) > 0, _spans(rest[s], F.col("before"))).alias(f"{s}_loss"))],
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    even = F.pmod("conv_id", F.lit(2)) == 0
    return conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(even, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
