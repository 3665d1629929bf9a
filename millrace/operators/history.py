"""Chat histories as messages of a prompt, and as transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, role, content, metadata): messages of any source; those without role are left out."""
    have = messages.columns
    meta = F.col("metadata").cast("map<string,string>") if "metadata" in have else F.lit(None).cast("map<string,string>")
    content = F.col("content") if "content" in have else F.col("text")
    return messages.select(conv, turn, "role", content.alias("content"), meta.alias("metadata")).where(F.col("role").isNotNull())


def for_batch() -> Column:
    """Messages that a batch prompt takes: user's and assistant's, without status messages."""
    return F.col("role").isin("user", "assistant") & (F.col("metadata").isNull() | (F.size("metadata") == 0))


def for_stream(status_too: bool = False) -> Column:
    """Messages that a streaming prompt takes: all but status messages."""
    return F.lit(True) if status_too else F.col("metadata").isNull() | (F.size("metadata") == 0)


def transcript(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, n, transcript): ``role: content`` lines of each conversation in order of turn.

    A conversation is put together in one task, as its transcript is one value.
    """
    line = F.concat_ws(": ", F.col("role"), F.coalesce("content", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return messages.groupBy(conv).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("transcript"))
