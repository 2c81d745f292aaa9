"""One turn over all sessions: number, prune, measure, recommend, truncate, hide, nudge once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_head_tail
from ..operators import blocks as B
from ..operators.messages import assign_refs, tag

EMERGENCY = 0.8


def run_turn(messages: DataFrame, blocks: DataFrame, members: DataFrame, limit: int, recent: int = 5, recent_tokens: int = 5000, hidden_calls: DataFrame | None = None, shown: DataFrame | None = None, most: int = 2000) -> dict[str, DataFrame]:
    """The tables of a turn.

    ``visible``: messages with their refs, as the model gets them: what active blocks cover and the
    ``hidden_calls`` (session_id, call_id) of archived blocks are left out, in an emergency large tool
    results are truncated to ``most`` characters, and all but the assistant's are ``tagged``. ``ranges``: what
    could be compressed, and what is protected. ``nudges``, by session: usage, the largest range, and
    whether a nudge goes out (``inject``): once for each last user message (``turn_key``; of a session
    without one, the session's id), as ``shown`` (session_id, turn_key) tells, but always in an emergency.
    ``shown``: that list after the turn.
    """
    refs = assign_refs(messages)
    usage = B.uncovered_tokens(messages, members)
    ranges = B.ranges(messages, members, recent, recent_tokens)
    top = B.top_range(ranges).select("session_id", F.col("lo").alias("top_lo"), F.col("hi").alias("top_hi"), F.col("tokens").alias("top_tokens"))
    last = F.max_by("id", F.struct("seq", "id")).alias("user_id")
    keys = messages.where("role = 'user'").groupBy("session_id").agg(last)
    in_view = B.uncovered(refs, members)
    counts = in_view.groupBy("session_id").agg(F.count("*").alias("n_visible"))
    share = F.col("tokens") / F.lit(float(limit))
    nudges = usage.join(counts, "session_id", "left").join(top, "session_id", "left").join(keys, "session_id", "left").na.fill(0, ["n_visible"])
    nudges = nudges.withColumn("emergency", share >= EMERGENCY).withColumn("should_nudge", F.col("top_tokens").isNotNull() & (share >= EMERGENCY / 2))
    nudges = nudges.withColumn("turn_key", F.coalesce("user_id", F.col("session_id").cast("string"))).drop("user_id")
    if shown is None:
        shown = nudges.select("session_id", "turn_key").limit(0)
    before = shown.select("session_id", "turn_key").distinct().withColumn("before", F.lit(True))
    nudges = nudges.join(before, ["session_id", "turn_key"], "left")
    nudges = nudges.withColumn("inject", F.col("should_nudge") & (F.col("emergency") | F.col("before").isNull())).drop("before")
    after = shown.select("session_id", "turn_key").unionByName(nudges.where("inject and not emergency").select("session_id", "turn_key")).distinct()
    visible = truncate_in_emergency(in_view, nudges, most)
    visible = visible if hidden_calls is None else hide_calls(visible, hidden_calls)
    return {"visible": tag(visible), "ranges": ranges, "nudges": nudges, "shown": after}


def hide_calls(messages: DataFrame, hidden_calls: DataFrame) -> DataFrame:
    """Messages without the rows of hidden calls, by call id or by their own; two joins, no OR."""
    hidden = hidden_calls.select("session_id", "call_id").distinct()
    out = messages.join(hidden.withColumnRenamed("call_id", "tool_call_id"), ["session_id", "tool_call_id"], "left_anti")
    return out.join(hidden.withColumnRenamed("call_id", "id"), ["session_id", "id"], "left_anti")


def truncate_in_emergency(visible: DataFrame, nudges: DataFrame, most: int = 2000) -> DataFrame:
    """In sessions close to their limit large tool results keep head and tail only."""
    hit = nudges.where("emergency").select("session_id", F.lit(True).alias("hit"))
    large = F.col("hit") & (F.col("role") == "tool") & (F.length("text") > most)
    return visible.join(hit, "session_id", "left").withColumn("text", F.when(large, truncate_head_tail("text", most)).otherwise(F.col("text"))).drop("hit")
