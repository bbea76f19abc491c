"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation is often a prefix of a longer one. A turn's hash takes in
its place; the hash of the first turns of a conversation is the running
exclusive-or of theirs, 128 bits in all. Role and text are hashed apart, so what
is rendered alike is not taken for the same; null counts as empty. A
conversation whose whole hash is the hash of a longer one's beginning goes,
before anything is rendered. A conversation's turns meet in one task, as its
rendering needs them together; conversations do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written


def rendered(role: Column, text: Column) -> Column:
    """A turn between its marks."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Maximal conversations: ``conv_id, n_turns, n_copies, chat``.

    Turns are ordered by ``turn``, then role and text; null roles and texts count
    as empty. A conversation that is the beginning of a longer one is dropped; of
    equal ones the smallest id stands for all, ``n_copies`` says how many there are.

    Turns without a conversation id belong to none and are left out; a null
    turn number comes first; repeated rows are turns of their own; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("at", F.row_number().over(order))
    hashed = placed.select(
        "conv_id", "turn", "role", "text", "at",
        F.xxhash64("at", "role", "text").alias("h0"), F.xxhash64(F.lit(1), "at", "role", "text").alias("h1"),
    )
    prefixes = hashed.select(
        "conv_id", "at", F.bit_xor("h0").over(upto).alias("p0"), F.bit_xor("h1").over(upto).alias("p1"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
    )
    prefixes = written(prefixes, "prefixes")
    key = ["at", "p0", "p1"]
    whole = prefixes.where("at = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.where("at < n").select(*key).distinct()
    kept = written(whole.join(longer, key, "left_anti").select("conv_id", "n_copies"), "maximal")
    chosen = rows.join(small(kept), "conv_id")
    return chosen.groupBy("conv_id", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["text"])), "").alias("chat"),
    )
