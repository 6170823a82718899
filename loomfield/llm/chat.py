"""Chat formatting: keep maximal logged conversations, then render them.

A chat log often holds a conversation several times, each time a few turns
longer. Such a cumulative snapshot is a strict prefix of a longer conversation
and carries nothing of its own. Everything here is DataFrame expressions.

The prefix hash of a turn is the XOR of position-dependent 64-bit hashes of all
turns up to it, twice with different constants (128 bits). XOR needs no order
inside an aggregate, so a conversation's prefix hashes are built from blocks of
turns and a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.tables import materialise

#: Turns that share turn div BLOCK are numbered in one window and rendered in one row.
BLOCK = 256


def _content(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("role"), F.col("text"))


def _turns(conversations: DataFrame) -> DataFrame:
    """The four columns, cleaned; rows without a conversation id belong to none."""
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, n (turns up to it), p1, p2 (prefix hash), last (whole conversation)."""
    slim = (
        _turns(conversations)
        .select("conv_id", "turn", "role", _content(1).alias("c1"), _content(2).alias("c2"))
        .distinct()
        .withColumn("block", F.expr(f"turn div {BLOCK}"))
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "c1", "c2")
    numbered = slim.withColumn("i", F.row_number().over(in_block))
    sizes = numbered.groupBy("conv_id", "block").agg(F.max("i").cast("long").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("conv_id")).alias("turns"),
    )
    placed = numbered.join(starts, ["conv_id", "block"]).withColumn("n", F.col("i") + F.col("before"))
    marks = placed.select(
        "conv_id", "block", "n", "turns",
        F.xxhash64("n", "c1", "c2", F.lit(3)).alias("z1"), F.xxhash64("n", "c2", "c1", F.lit(4)).alias("z2"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = marks.select(
        "conv_id", "block", "n", "turns", F.bit_xor("z1").over(upto).alias("o1"), F.bit_xor("z2").over(upto).alias("o2")
    )
    totals = marks.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"))
    carried = totals.select(
        "conv_id", "block",
        F.coalesce(F.bit_xor("t1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("t2").over(earlier), F.lit(0)).alias("b2"),
    )
    return own.join(carried, ["conv_id", "block"]).select(
        "conv_id", "n",
        F.col("o1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("o2").bitwiseXOR(F.col("b2")).alias("p2"),
        (F.col("n") == F.col("turns")).alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that no longer one starts with.

    Of equal conversations the smallest conv_id stands for all; n_copies counts
    them. Defined cases are those of ``render_conversations``. The hashes are
    written once, as they are needed for whole conversations and for prefixes.
    """
    prefixes = materialise(prefix_hashes(conversations), "prefixes", True)
    whole = prefixes.where("last").groupBy("p1", "p2", "n").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")
    )
    proper = prefixes.where("NOT last").select("p1", "p2", "n").distinct()
    kept = whole.join(proper, ["p1", "p2", "n"], "left_anti")
    return kept.select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render_conversations(conversations: DataFrame) -> DataFrame:
    """Render every maximal conversation; one row per conversation and block of 256 turn numbers.

    Returns conv_id, part (turn div 256; null turns come last, all in one part; a
    conversation is its parts in order), n_turns, n_copies
    and rendered: each turn as ``<|role|>`` line, text, ``<|end|>`` line, in order
    of (turn, role, content). Defined cases: rows with a null conv_id are ignored;
    a null role reads ``unknown``, a null text is empty, a null turn comes last;
    fully repeated rows count once; an empty table gives no rows; other columns
    are ignored.
    """
    kept = maximal_conversations(conversations)
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    entry = F.struct("turn", "role", _content(1).alias("c1"), _content(2).alias("c2"), line.alias("line"))
    return (
        _turns(conversations)
        .join(kept, "conv_id")
        .groupBy("conv_id", F.expr(f"turn div {BLOCK}").alias("part"))
        .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.collect_set(entry).alias("lines"))
        .select(
            "conv_id", "part", "n_turns", "n_copies",
            F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "").alias("rendered"),
        )
    )
