"""Chat history: context windows, pages, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T


def context_messages(msgs: DataFrame, max_messages: int = 100, max_chars: int = 30000) -> DataFrame:
    """Per session the newest messages that fit, oldest first (``place``).

    The newest message is always in; going back stops before the total passes ``max_chars``.  Lengths are not negative,
    so the running total tells where it stops.  Empty messages, and those of neither user nor assistant, are dropped
    after that.
    """
    back = W.Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    n = msgs.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= max_messages)
    total = F.sum(F.length(F.coalesce("content", F.lit("")))).over(back.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    kept = n.withColumn("_sum", total).where((F.col("_rn") == 1) | (F.col("_sum") <= max_chars)).where((F.coalesce("content", F.lit("")) != "") & F.col("role").isin("user", "assistant"))
    return kept.withColumn("place", F.row_number().over(W.Window.partitionBy("session_id").orderBy("created_at", "id"))).drop("_rn", "_sum")


def message_page(msgs: DataFrame, session_id: int, page: int = 1, size: int | None = None) -> DataFrame:
    """One page of a session's messages in time order, and how many there are."""
    own = msgs.where(F.col("session_id") == session_id)
    offset, size = T.page_bounds("messages", page, size)
    total = own.agg(F.count(F.lit(1)).alias("matches"))
    return own.orderBy("created_at", "id").offset(offset).limit(size).join(F.broadcast(total))


def rollup_chat_sessions(sessions: DataFrame, msgs: DataFrame) -> DataFrame:
    """Message count, last activity, and for blank titles the start of the first user message."""
    user = F.col("role") == "user"
    n = msgs.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("_last"), F.min_by(F.when(user, F.col("content")), F.when(user, F.struct("created_at", "id"))).alias("_first"))
    out = sessions.drop("message_count").join(n, sessions.id == n.session_id, "left")
    title = F.when(T.is_blank(F.col("title")) & F.col("_first").isNotNull(), T.title_from(F.col("_first"))).otherwise(F.col("title"))
    return out.withColumn("title", title).withColumn("message_count", F.coalesce("message_count", F.lit(0))).withColumn("updated_at", F.coalesce("_last", "updated_at")).drop("_last", "_first", "session_id")


def list_chat_sessions(sessions: DataFrame, descending: bool = False) -> DataFrame:
    """C4: sessions by last activity, oldest first unless told otherwise."""
    return sessions.orderBy(F.desc("updated_at") if descending else F.asc("updated_at"), "id")


def delete_chat_sessions(sessions: DataFrame, msgs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of ``ids`` (id)."""
    return sessions.join(ids.select("id"), "id", "left_anti"), msgs.join(ids.select(F.col("id").alias("session_id")), "session_id", "left_anti")
