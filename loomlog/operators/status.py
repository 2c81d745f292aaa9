"""Reports and the small rules around them: listings, roles, switches, prompts, limits of ended runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .events import EOF_S, KILL_S

#: How a listing may be sorted: name -> order within a session.
SORTS = {
    "size": lambda: [F.desc("tokens"), "seq"],
    "time": lambda: ["seq"],
    "age": lambda: [F.desc("seq")],
    "tool": lambda: [F.asc_nulls_last("tool_name"), F.desc("tokens"), "seq"],
}


def listing(messages: DataFrame, sort: str = "size", tool: str | None = None, limit: int = 30) -> DataFrame:
    """The first ``limit`` messages of each session in an order, of one tool or of all."""
    rows = messages.withColumn("tokens", token_estimate("text"))
    if tool is not None:
        rows = rows.where(F.col("tool_name") == tool)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(*SORTS[sort]()))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def search_role(role: Column) -> Column:
    """Roles that search knows; others are null."""
    return F.when(role.isin("user", "assistant"), role).when(role == "toolResult", "tool")


def has_vision(inputs: Column) -> Column:
    return F.coalesce(F.array_contains(inputs, "image"), F.lit(False))


def archiving_enabled(switch: Column, vision: Column) -> Column:
    """``on``, ``off``, or else as the model can see."""
    return F.when(switch == "on", True).when(switch == "off", False).otherwise(F.coalesce(vision, F.lit(False)))


def positive_or(value: Column, default: float) -> Column:
    return F.when(value > 0, value).otherwise(default)


def extend_prompt(base: Column, extra: Column) -> Column:
    """A prompt of parts (an array) as one text, and an addition after a blank line."""
    return F.concat(F.coalesce(F.array_join(base, "\n"), F.lit("")), F.lit("\n\n"), extra)


def error_lists(errors: DataFrame, most: int = 3) -> DataFrame:
    """The first errors of each session and how many there are."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "error")))
    rows = errors.groupBy("session_id").agg(F.transform(ordered, lambda e: e["error"]).alias("all"))
    return rows.select("session_id", F.slice("all", 1, most).alias("errors"), F.size("all").cast("long").alias("n_errors"))


def append_archived(old: Column, new: Column) -> Column:
    """Ids are appended as they come, repeats too."""
    return F.concat(F.coalesce(old, F.array().cast("array<string>")), new)


def elapsed_s(started: Column, now: Column) -> Column:
    """Whole seconds since a start, not below zero."""
    return F.greatest(F.lit(0), F.round((F.unix_micros(now) - F.unix_micros(started)) / 1_000_000)).cast("long")


def running_totals(blocks: DataFrame) -> DataFrame:
    """What has been compressed so far, block by block."""
    order = Window.partitionBy("session_id").orderBy("created_at", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("session_id", "block_id", F.sum("compressed_tokens").over(order).cast("long").alias("tokens_so_far"), F.count("*").over(order).alias("n_so_far"))


def escalation(stops: DataFrame) -> DataFrame:
    """``stops`` (run_id, stopped_at, settled_at): a soft stop turns hard where the run hasn't settled
    in time."""
    late = F.unix_micros("settled_at") - F.unix_micros("stopped_at") > KILL_S * 1_000_000
    return stops.withColumn("signal", F.when(F.col("settled_at").isNull() | late, "hard").otherwise("soft"))


def finish(runs: DataFrame) -> DataFrame:
    """``runs`` (run_id, eof_at, exit_at): a run ends with its process, or some seconds after the end
    of its output, whichever comes first; only then the exit code is unknown."""
    grace = F.timestamp_micros(F.unix_micros("eof_at") + EOF_S * 1_000_000)
    by_eof = F.col("exit_at").isNull() | (F.col("exit_at") > grace)
    return runs.withColumn("ended_at", F.least("exit_at", grace)).withColumn("by_eof", F.coalesce(by_eof & F.col("eof_at").isNotNull(), F.lit(False)))


def present_frames(frames: DataFrame, listing: DataFrame) -> DataFrame:
    """Frames whose file is there; ``listing`` has the store's paths, named by hash."""
    there = listing.select(F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1).alias("sha")).distinct()
    return frames.join(there, "sha", "left_semi")
