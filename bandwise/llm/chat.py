"""Cumulative-snapshot collapse of logged conversations, then chat formatting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.common import written

#: Turns of a conversation that one window task sees together; longer ones are chained slice by slice.
SLICE_TURNS = 256
OPENING, CLOSING = "<|im_start|>", "<|im_end|>"


def _turn_hashes() -> list[Column]:
    parts = [F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, k, n, p1, p2) for every turn: the hash of the conversation's first k of n turns.

    The hash rolls: it is the running xor of a hash of each turn with its position. It runs inside slices of turn
    numbers and is carried over them, so a conversation of any length is spread over tasks.
    """
    order = ["turn", "h1", "h2"]
    rows = written(turns.withColumn("slice", F.floor(F.coalesce("turn", F.lit(-SLICE_TURNS)) / SLICE_TURNS)))
    same = ["conv", "slice"]
    slices = rows.groupBy(*same).agg(F.count("*").alias("m"))
    along = Window.partitionBy("conv").orderBy("slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("conv", "slice", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"),
                           F.sum("m").over(Window.partitionBy("conv")).alias("n"))
    within = Window.partitionBy(*same).orderBy(*order)
    placed = rows.withColumn("row", F.row_number().over(within))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("conv", "_conv").withColumnRenamed("slice", "_slice")
        return a.join(b, a["conv"].eqNullSafe(b["_conv"]) & (a["slice"] == b["_slice"])).drop("_conv", "_slice")

    placed = met(placed, slices).withColumn("k", F.col("base") + F.col("row"))
    placed = written(placed.select("conv", "slice", "k", "n", F.xxhash64("k", "h1").alias("x1"),
                                   F.xxhash64("k", "h2", F.lit(2)).alias("x2")))
    totals = placed.groupBy(*same).agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    carried = totals.select("conv", "slice", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"c{i}")
                                               for i in (1, 2)])
    running = Window.partitionBy(*same).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv", "slice", "k", "n", *[F.bit_xor(f"x{i}").over(running).alias(f"r{i}") for i in (1, 2)])
    return met(rolled, carried).select("conv", "k", "n", F.col("r1").bitwiseXOR(F.col("c1")).alias("p1"),
                                       F.col("r2").bitwiseXOR(F.col("c2")).alias("p2"))


def collapse_snapshots(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """(conv, n_turns) of the maximal conversations: those that are no prefix of a longer one. Of equal conversations
    the one with the smallest id stays.

    Turns are ordered by turn, null turns first, ties by content; null roles and texts equal only nulls. Rows without
    a conversation id form one conversation with a null id. Repeated rows are turns of their own.
    """
    turns = log.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                       F.col(text_col).alias("text")).select("conv", "turn", *_turn_hashes())
    prefixes = written(prefix_hashes(turns))
    state = ["k", "p1", "p2"]
    whole = prefixes.where("k = n").groupBy(*state).agg(F.min("conv").alias("conv"))
    longer = prefixes.where("k < n").groupBy(*state).agg(F.lit(1).alias("one")).drop("one")  # combined before the shuffle
    return whole.join(longer, state, "left_anti").select("conv", F.col("k").alias("n_turns"))


def render_chats(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: its id, n_turns and text, every turn between role header and end mark.

    Marks inside a text are escaped by a backslash; null roles and texts render empty. A conversation is one string
    in the result, so its text must fit a row. Very long turns are hashed, and only those kept are joined to a text. An
    empty table gives no rows.
    """
    kept = collapse_snapshots(log, conv_col, turn_col, role_col, text_col)
    turns = log.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                       F.col(text_col).alias("text"))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    piece = F.concat(F.lit(OPENING), F.coalesce("role", F.lit("")), F.lit("\n"), clean, F.lit(CLOSING + "\n"))
    ids = kept.withColumnRenamed("conv", "_conv")
    mine = turns.join(ids, turns["conv"].eqNullSafe(ids["_conv"])).select(
        "conv", "n_turns", F.struct("turn", *_turn_hashes(), piece.alias("piece")).alias("t"))
    return mine.groupBy("conv", "n_turns").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        F.col("conv").alias(conv_col), "n_turns", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"))


ORACLE = """
WITH c AS (SELECT conv_id, count(*) AS n_turns,
                  list(struct_pack(r := role, t := text) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
w AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns)
SELECT conv_id, n_turns, array_to_string(['<|im_start|>' || coalesce(x.r, '') || chr(10) ||
         regexp_replace(coalesce(x.t, ''), '<\\|(im_start|im_end)\\|>', '<\\\\|\\1|>', 'g') || '<|im_end|>' || chr(10)
         for x in turns], '') AS text
FROM w ANTI JOIN p USING (turns)
"""
