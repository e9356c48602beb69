"""Chat formatting after the collapse of cumulative snapshots.

A log often holds a conversation many times, each snapshot a few turns longer. Every turn gets the rolling
hash of the turns up to it (two 64-bit sums of hashes over position, role and text). A conversation that
ends where a longer one only passes, at equal position and hash, is a snapshot of it and goes (anti-join);
of equal conversations the smallest conv_id stays. What is left is rendered, one line group a turn.

Positions are counted in blocks of turn numbers, so that a huge conversation is no single window; the
join is on the distinct hashes of prefixes, so that a first turn that very many conversations share is one
row. Null roles and texts hash apart from empty ones and render as empty; null turns come first; turns of
equal number are ordered by role and text. A null conv_id is a conversation too. Rows that repeat are turns
that repeat. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellforge.llm.common import stored

#: Turn numbers of a block.
BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>\n"


def _key() -> F.Column:
    """A conversation's key as text; that of a null conv_id is no other one's."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, at (position from 1), h1, h2 (hashes of the turns up to it) and last (whether it ends the conversation)."""
    t = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), "role", "text").withColumn("block", F.floor(F.col("turn") / BLOCK))
    t = t.withColumn("key", _key())
    order = [F.col("turn"), F.col("role"), F.col("text")]
    inner = Window.partitionBy("key", "block").orderBy(*order)
    blocks = t.groupBy("key", "block").agg(F.count("*").alias("n"))
    along = Window.partitionBy("key").orderBy("block")
    blocks = blocks.select("key", "block", (F.sum("n").over(along) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("key")).alias("turns"))
    at = t.withColumn("in_block", F.row_number().over(inner)).join(blocks, ["key", "block"]).withColumn("at", F.col("ahead") + F.col("in_block"))
    mark = lambda seed: F.xxhash64(F.lit(seed), "at", F.coalesce(F.xxhash64("role"), F.lit(0)), F.col("role").isNull(), F.coalesce(F.xxhash64(F.lit(seed), "text"), F.lit(0)), F.col("text").isNull()).cast("decimal(38,0)")
    at = stored(at.select("conv_id", "key", "block", "at", "turns", mark(1).alias("m1"), mark(2).alias("m2")), "turns")
    sums = at.groupBy("key", "block").agg(F.sum("m1").alias("s1"), F.sum("m2").alias("s2"))
    sums = sums.select("key", "block", *[(F.sum(f"s{i}").over(along) - F.col(f"s{i}")).alias(f"a{i}") for i in (1, 2)])
    upto = Window.partitionBy("key", "block").orderBy("at")
    rolled = at.join(sums, ["key", "block"]).select("conv_id", "key", "at", "turns", *[(F.sum(f"m{i}").over(upto) + F.col(f"a{i}")).alias(f"h{i}") for i in (1, 2)])
    return rolled.withColumn("last", F.col("at") == F.col("turns")).drop("turns")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and key of the conversations that no other one contains as a prefix, once each."""
    p = stored(prefixes(turns), "prefixes")
    whole = p.where("last").groupBy("at", "h1", "h2").agg(F.min(F.struct(F.col("conv_id"), F.col("key"))).alias("c"))
    passed = p.where("NOT last").select("at", "h1", "h2").distinct()
    return whole.join(passed, ["at", "h1", "h2"], "left_anti").select("c.conv_id", "c.key")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered of each maximal conversation."""
    kept = maximal(turns)
    t = turns.select(_key().alias("key"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), "role", "text")
    lines = t.join(kept, "key").groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    said = F.transform("ts", lambda x: F.concat(F.lit(START), F.coalesce(x.role, F.lit("")), F.lit("\n"), F.coalesce(x.text, F.lit("")), F.lit(END)))
    return lines.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(said, "").alias("rendered"))
