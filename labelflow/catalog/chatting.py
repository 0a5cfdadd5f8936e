"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables
from labelflow.operators import chat as c


@query("message_counts_a35", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1")
def message_counts(t: Tables):
    return c.message_counts(t.chat)


@query(
    "preceding_user_j6",
    """SELECT b.conv_id, b.turn, b.user_turn, md5(nullif(trim(u.text), '')) AS source_md5
       FROM (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (
                 PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn
             FROM conversations) b
       LEFT JOIN conversations u ON u.conv_id = b.conv_id AND u.turn = b.user_turn AND u.role = 'user'
       WHERE b.role = 'assistant'""",
)
def preceding_user(t: Tables):
    out = c.preceding_user_text(t.chat, block=4)  # small blocks, so that carrying over is exercised
    return out.select("conv_id", "turn", "user_turn", F.md5("source_text").alias("source_md5"))
