"""Events of delegated runs, as batch operators: parsing, deltas, segments, replies, limits, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

EVENT = (
    "type string, assistantMessageEvent struct<type: string, delta: string, content: string>, toolName string, toolCallId string, "
    "args string, partialResult struct<content: array<struct<type: string, text: string>>>, isError boolean, "
    "attempt bigint, maxAttempts bigint, delayMs bigint, errorMessage string, success boolean"
)
IDLE_S, HARD_S, SYNC_S, EOF_S, KILL_S = 300, 1800, 300, 10, 10
WAIT_DEFAULT_S, WAIT_MOST_S = 10, 300


def parse_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """NDJSON lines -> kind and its fields; bad JSON, unknown types and subtypes drop out."""
    e = F.from_json(F.col(column), EVENT)
    rows = lines.withColumn("e", e)
    kind = (
        F.when(F.col("e.type") == "message_update", F.expr("map('text_delta', 'reply-delta', 'text_end', 'reply-complete', 'thinking_delta', 'thinking-delta', 'thinking_end', 'thinking-end')[e.assistantMessageEvent.type]"))
        .when(F.col("e.type") == "tool_execution_start", "tool-start")
        .when(F.col("e.type") == "tool_execution_update", "tool-update")
        .when(F.col("e.type") == "tool_execution_end", "tool-end")
        .when(F.col("e.type") == "auto_retry_start", "retry-start")
        .when(F.col("e.type") == "auto_retry_end", "retry-end")
    )
    parts = F.transform(F.col("e.partialResult.content"), lambda p: F.coalesce(p["text"], F.lit("")))
    args = F.coalesce(F.get_json_object("e.args", "$.command"), F.col("e.args"), F.lit(""))
    text = (
        F.when(F.col("kind").isin("reply-delta", "thinking-delta"), F.coalesce("e.assistantMessageEvent.delta", F.lit("")))
        .when(F.col("kind") == "reply-complete", F.coalesce("e.assistantMessageEvent.content", F.lit("")))
        .when(F.col("kind") == "tool-update", F.coalesce(F.array_join(parts, ""), F.lit("")))
        .when(F.col("kind") == "tool-start", args)
        .when(F.col("kind") == "retry-start", F.coalesce("e.errorMessage", F.lit("")))
        .otherwise("")
    )
    out = rows.withColumn("kind", kind).where("kind is not null").withColumn("text", text)
    return out.select(
        *(c for c in lines.columns if c != column),
        "kind",
        "text",
        F.coalesce("e.toolName", F.lit("")).alias("tool_name"),
        F.coalesce("e.toolCallId", F.lit("")).alias("call_id"),
        F.coalesce("e.isError", F.lit(False)).alias("is_error"),
        F.coalesce("e.attempt", F.lit(0)).cast("long").alias("attempt"),
        F.coalesce("e.maxAttempts", F.lit(0)).cast("long").alias("max_attempts"),
        F.coalesce("e.delayMs", F.lit(0)).cast("long").alias("delay_ms"),
        F.coalesce("e.success", F.lit(False)).alias("success"),
    )


def activity(events: DataFrame) -> Column:
    """The line of an activity log that an event makes, without its line feed; null for none."""
    space = lambda c: F.when(c != "", F.concat(F.lit(" "), c)).otherwise("")
    failed = F.when(F.col("is_error"), " (error)").otherwise("")
    reason = F.when(F.col("text") != "", F.concat(F.lit(" — "), "text")).otherwise("")
    return (
        F.when(F.col("kind") == "tool-start", F.concat(F.lit("[tool] "), "tool_name", space(F.col("text"))))
        .when((F.col("kind") == "tool-update") & (F.col("text") != ""), F.regexp_replace("text", r"\n\z", ""))
        .when(F.col("kind") == "tool-end", F.concat(F.lit("[done] "), "tool_name", failed))
        .when(F.col("kind") == "thinking-delta", F.concat(F.lit("[thinking] "), "text"))
        .when(F.col("kind") == "retry-start", F.concat(F.lit("[retry] attempt "), "attempt", F.lit("/"), "max_attempts", F.lit(", backoff "), "delay_ms", F.lit("ms"), reason))
        .when(F.col("kind") == "retry-end", F.concat(F.lit("[retry] attempt "), "attempt", F.when(F.col("success"), " succeeded").otherwise(" failed")))
    )


def _order() -> list:
    return ["ts", "event_id"]


def tool_deltas(events: DataFrame) -> DataFrame:
    """What each snapshot of a call's output adds: the rest, if it goes on from the one before, else
    the whole."""
    w = Window.partitionBy("run_id", "call_id").orderBy(*_order())
    before = F.coalesce(F.lag("text").over(w), F.lit(""))
    rows = events.where("kind = 'tool-update'").withColumn("before", before)
    goes_on = F.col("text").startswith(F.col("before"))
    return rows.withColumn("delta", F.when(goes_on, F.substr("text", F.length("before") + 1)).otherwise(F.col("text"))).drop("before")


def thinking_segments(events: DataFrame) -> DataFrame:
    """Thinking between other events, joined; blank segments drop out."""
    w = Window.partitionBy("run_id").orderBy(*_order())
    ends = (F.col("kind") != "thinking-delta").cast("long")
    rows = events.withColumn("segment", F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'thinking-delta'")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "text")))
    out = rows.groupBy("run_id", "segment").agg(trimmed(F.array_join(F.transform(ordered, lambda x: x["text"]), "")).alias("thinking"))
    return out.where("thinking <> ''")


def replies(events: DataFrame) -> DataFrame:
    """The reply of each run: the last complete text and the deltas after it."""
    rows = events.where("kind in ('reply-delta', 'reply-complete')")
    place = F.struct(*_order())
    done = F.max(F.when(F.col("kind") == "reply-complete", place)).over(Window.partitionBy("run_id"))
    rows = rows.withColumn("done", done).where(F.col("done").isNull() | (place >= F.col("done")))
    ordered = F.array_sort(F.collect_list(F.struct(*_order(), "text")))
    return rows.groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("reply"))


def idle_gaps(events: DataFrame, seconds: int = IDLE_S) -> DataFrame:
    """Gaps between neighbouring events of a run that exceed the limit."""
    w = Window.partitionBy("run_id").orderBy(*_order())
    rows = events.withColumn("before", F.lag("ts").over(w))
    gap = F.unix_micros("ts") - F.unix_micros("before")
    return rows.where(gap > seconds * 1_000_000).select("run_id", "event_id", (gap / 1_000_000).alias("gap_s"))


def hard_limit(events: DataFrame, seconds: int = HARD_S) -> DataFrame:
    """Events that come later than the limit after their run's first."""
    rows = events.withColumn("started", F.min("ts").over(Window.partitionBy("run_id")))
    late = rows.where(F.unix_micros("ts") - F.unix_micros("started") > seconds * 1_000_000)
    return late.groupBy("run_id").agg(F.count("*").alias("n_late"), F.min_by("event_id", F.struct(*_order())).alias("first_late"))


def finalize_once(endings: DataFrame) -> DataFrame:
    """The first ending of each run counts; later ones are ignored."""
    return endings.groupBy("run_id").agg(F.min_by(F.struct(*_order(), "cause"), F.struct(*_order())).alias("e"), F.count("*").alias("n_endings")).select("run_id", "e.cause", "e.event_id", "n_endings")


def run_status(code: Column, has_output: Column) -> Column:
    """No exit code but output counts as success."""
    effective = F.coalesce(code, F.when(has_output, 0))
    return F.when(effective.eqNullSafe(0), "completed").otherwise("failed")


def delivery(waiting: Column, consumed: Column, can_inject: Column) -> Column:
    """Each result goes one way: to who waits, nowhere if it was read already, else into the session."""
    return F.when(waiting, "wait").when(consumed, "consumed").when(can_inject, "inject").otherwise("held")


def wait_clamp(seconds: Column) -> Column:
    return F.least(F.lit(float(WAIT_MOST_S)), F.greatest(F.lit(1.0), F.coalesce(seconds, F.lit(float(WAIT_DEFAULT_S)))))


def latest(events: DataFrame, value: str) -> DataFrame:
    """The registry of runs: the last value of each."""
    return events.groupBy("run_id").agg(F.max_by(value, F.struct(*_order())).alias(value), F.min("ts").alias("started_at"))
