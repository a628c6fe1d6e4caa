"""Query over conversations: chat formatting, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.llm.chat_format import format_messages, loss_text, text_part, turns_of
from brindle.llm.common import plain_table
from brindle.llm.registry import query

HARD_CASE = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, 'ESC', '\1\\\2\3', 'g') AS et, regexp_replace(role, 'ESC', '\1\\\2\3', 'g') AS er FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(er) + length(et) + length('<|start|>') + length('<|message|>') + length('<|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("ESC", r"([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>|/?think>|/?tool_call>|/?image>|/?audio>|/?document>)")


@query("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark, sf_dir):
    """All conversations and one of control strings, formatted and read back from the formatted string."""
    messages = plain_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_CASE).alias("text"))
    messages = messages.unionByName(hard).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    f = format_messages(messages).select("conv_id", "formatted")
    f = f.withColumn("turns", turns_of(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted")))
    return f.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
