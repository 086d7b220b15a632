"""Chat formatting: preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (same role, same text) is rendered once as the prompt; what follows in
each becomes a completion, and a mask says which spans of it are trained on (the
text of assistant turns with its end marker) and which are context (role headers
and all other turns).

Turns are matched with one full outer join per pair and turn, the first
difference is a grouped minimum, and each side is gathered per pair only for
its own rendering.  Turns are ordered by ``turn``; equal rows of a turn count once,
different ones follow each other by role and text; a null text is empty, a null role is ``user``; a turn or conversation id
that is null is left out.  A conversation without partner makes no pair.
Identical conversations have empty completions and are flagged.  Very long
turns are rendered whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table, slim

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit(CLOSE))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the messages of each turn, without nulls in role and text."""
    clean = slim(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    clean = clean.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("text", F.coalesce("text", F.lit(""))).distinct()
    return clean.withColumn("part", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))


def neighbours(conversations: DataFrame) -> DataFrame:
    """conv_id, pair_id, chosen: conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    ids = slim(conversations, "conv_id").where("conv_id is not null").distinct()
    return ids.select("conv_id", F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"))


def borrowed_ends(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pairs) in which both sides share all turns but one.

    Chosen is a conversation as it is; rejected is the same with the text of
    its last assistant message replaced by that of the conversation with the
    next id.  A conversation without that neighbour, or where either has no
    assistant message, makes no pair.  Pairs have the id of their conversation;
    the ids of both sides are structs of it and which side they are.
    """
    turns = persist_table(turns_of(conversations), "turns")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "part", "text")).alias("m"))
    place = last.select("conv_id", F.struct("m.turn", "m.part").alias("_at"))
    # the smallest id has no id before it
    donor = last.select(F.try_subtract("conv_id", F.lit(1)).alias("conv_id"), F.col("m.text").alias("_text")).where("conv_id is not null")
    ends = persist_table(place.join(donor, "conv_id"), "ends")
    met = turns.join(ends, "conv_id")
    other = F.when(F.struct("turn", "part").eqNullSafe(F.col("_at")), F.col("_text")).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit(True).alias("chosen"), F.col("text").alias("text")), F.struct(F.lit(False).alias("chosen"), other.alias("text")))
    both = met.withColumn("_s", F.explode(sides)).select(F.struct("conv_id", "_s.chosen").alias("conv_id"), "turn", "role", "_s.text")
    ids = ends.select("conv_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("chosen"))
    return both, ids.select(F.struct("conv_id", "chosen").alias("conv_id"), F.col("conv_id").alias("pair_id"), "chosen")


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair of ``pairs(conv_id, pair_id, chosen)`` that has both sides.

    pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected
    (rendered completions), chosen_mask, rejected_mask (arrays of
    (start, length, trained) over the completions, in characters), identical.
    """
    turns = turns_of(conversations).join(slim(pairs, "conv_id", "pair_id", "chosen"), "conv_id")
    side = F.when(F.col("chosen"), 1)
    other = F.when(~F.col("chosen"), 1)
    # both sides of a message meet in one group of at most two rows
    met = turns.groupBy("pair_id", "turn", "part").agg(
        F.max(F.when(side == 1, F.struct("role", "text"))).alias("c"),
        F.max(F.when(other == 1, F.struct("role", "text"))).alias("r"),
        F.max(F.when(side == 1, F.col("conv_id"))).alias("c_id"),
        F.max(F.when(other == 1, F.col("conv_id"))).alias("r_id"),
    )
    place = F.struct("turn", "part")
    first = met.groupBy("pair_id").agg(
        F.min(F.when(~F.coalesce(F.col("c").eqNullSafe(F.col("r")), F.lit(False)), place)).alias("at"),
        F.max("c_id").alias("chosen_id"),
        F.max("r_id").alias("rejected_id"),
    )
    first = first.where("chosen_id is not null and rejected_id is not null")
    held = met.join(first, "pair_id").withColumn("common", F.coalesce(place < F.col("at"), F.lit(True)))
    before = Window.partitionBy("pair_id", "common").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    for x in ("c", "r"):
        role = F.col(f"{x}.role")
        held = held.withColumn(f"{x}_text", F.when(F.col(x).isNotNull(), rendered(role, F.col(f"{x}.text"))))
        held = held.withColumn(f"{x}_start", F.coalesce(F.sum(F.length(f"{x}_text").cast("bigint")).over(before), F.lit(0).cast("bigint")))

    def gathered(keep: Column, turn: str) -> Column:
        role = F.col(f"{turn}.role")
        part = F.struct("turn", "part", role.alias("role"), F.col(f"{turn}_text").alias("text"), F.col(f"{turn}_start").alias("start"), F.length(header(role)).cast("bigint").alias("head"))
        return F.array_sort(F.collect_list(F.when(keep & F.col(turn).isNotNull(), part)))

    sides = held.groupBy("pair_id").agg(
        F.first("chosen_id").alias("chosen_id"),
        F.first("rejected_id").alias("rejected_id"),
        F.count(F.when(F.col("common"), 1)).alias("n_prompt_turns"),
        gathered(F.col("common"), "c").alias("p"),
        gathered(~F.col("common"), "c").alias("c"),
        gathered(~F.col("common"), "r").alias("r"),
    )

    def text(side: str) -> Column:
        return F.array_join(F.transform(side, lambda t: t["text"]), "")

    def mask(side: str) -> Column:
        span = lambda start, length, trained: F.struct(start.alias("start"), length.alias("length"), trained.alias("trained"))
        return F.flatten(F.transform(side, lambda t: F.array(span(t["start"], t["head"], F.lit(False)), span(t["start"] + t["head"], F.length(t["text"]).cast("bigint") - t["head"], t["role"] == "assistant"))))

    return sides.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prompt_turns",
        text("p").alias("prompt"),
        text("c").alias("chosen"),
        text("r").alias("rejected"),
        mask("c").alias("chosen_mask"),
        mask("r").alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The pairs with texts as SHA-256 and the masks as counts of trained characters."""

    def trained(side: str) -> Column:
        return F.expr(f"aggregate({side}_mask, 0L, (n, s) -> n + if(s.trained, s.length, 0L))")

    return formatted.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "identical",
        *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        *[F.length(c).cast("bigint").alias(f"{c}_chars") for c in ("prompt", "chosen", "rejected")],
        trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained"),
    )
