"""Conversation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def message_counts(chat: DataFrame) -> DataFrame:
    return chat.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


def preceding_user_text(
    chat: DataFrame, bot_role: str = "assistant", user_role: str = "user", block: int = BLOCK
) -> DataFrame:
    """(conv_id, turn, user_turn, source_text) for each bot turn: the nearest earlier user message.

    A blank message gives a null text. A conversation may be huge, so it is cut into blocks of turns: the
    last user turn is found inside each block, then carried over blocks (one row per block), and the text
    is fetched by key. Only (conv_id, turn, role) pass through the windows.
    """
    number = F.floor(F.col("turn") / block).cast("long")
    turns = chat.filter(F.col("role").isin(bot_role, user_role)).select(
        "conv_id", "turn", "role", number.alias("block")
    )
    user_turn = F.when(F.col("role") == user_role, F.col("turn"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    near = turns.withColumn(
        "near",
        F.last(user_turn, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
    )
    tails = turns.groupBy("conv_id", "block").agg(F.max(user_turn).alias("tail"))
    earlier = (
        Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select("conv_id", "block", F.max("tail").over(earlier).alias("carried"))
    bots = (
        near.filter(F.col("role") == bot_role)
        .join(carried, ["conv_id", "block"])
        .select("conv_id", "turn", F.coalesce("near", "carried").alias("user_turn"))
    )
    texts = chat.filter(F.col("role") == user_role).select(
        "conv_id", F.col("turn").alias("user_turn"), F.trim("text").alias("body")
    )
    return bots.join(texts, ["conv_id", "user_turn"], "left").select(
        "conv_id",
        "turn",
        "user_turn",
        F.when(F.length("body") > 0, F.col("body")).alias("source_text"),
    )
