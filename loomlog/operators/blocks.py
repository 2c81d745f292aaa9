"""Blocks of compressed messages: what they cover, own, cost, and which are hot, cold or archived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quarter_tokens, token_estimate

SESSION = ["session_id"]
ROW = ["session_id", "id"]


def active(blocks: DataFrame) -> DataFrame:
    """A missing flag counts as inactive."""
    return blocks.where(F.coalesce("active", F.lit(False)))


def uncovered(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Messages that no active block covers."""
    return messages.join(active(members).select(*ROW), ROW, "left_anti")


def covered(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Messages that any block covers, active or not."""
    return messages.join(members.select(*ROW), ROW, "left_semi")


def uncovered_tokens(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Tokens in view per session; results of compressing don't count, sessions with nothing in view
    report 0."""
    covered_ids = active(members).select(*ROW).distinct().withColumn("covered", F.lit(True))
    # tokens are counted before the join, so that texts aren't shuffled; sessions stay in one pass
    counted = messages.select(*ROW, F.when(F.col("tool_name").eqNullSafe("compress"), 0).otherwise(token_estimate("text")).alias("t"))
    flagged = counted.join(covered_ids, ROW, "left")
    return flagged.groupBy("session_id").agg(F.sum(F.when(F.col("covered").isNull(), F.col("t")).otherwise(0)).cast("long").alias("tokens"))


def owners(members: DataFrame) -> DataFrame:
    """The first block, by position, that has each message."""
    return members.groupBy(*ROW).agg(F.min_by(F.struct("block_id", "tier"), F.struct("pos", "block_id")).alias("o")).select(*ROW, F.col("o.block_id").alias("owner"), F.coalesce("o.tier", F.lit(1)).alias("tier"))


def oldest_first(blocks: DataFrame) -> Window:
    return Window.partitionBy("session_id").orderBy("created_at", "pos")


def newest_first() -> Window:
    return Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("pos"))


def cold(blocks: DataFrame, hot: int = 6) -> DataFrame:
    """Active blocks but the newest ``hot`` of their session."""
    return active(blocks).withColumn("age", F.row_number().over(newest_first())).where(F.col("age") > hot).drop("age")


def unsnapped(blocks: DataFrame, archived: DataFrame) -> DataFrame:
    """Blocks (session_id, block_id) that aren't archived."""
    return blocks.join(archived.select("session_id", "block_id"), ["session_id", "block_id"], "left_anti")


def gate(blocks: DataFrame, least: int, usage: DataFrame | None = None, overflow: float = 0.8) -> DataFrame:
    """Sessions' blocks, if their summaries' tokens reach ``least`` or the session's usage (a share of
    its limit) ``overflow``; else none of them."""
    sums = blocks.groupBy("session_id").agg(F.sum(quarter_tokens("summary")).alias("pending"))
    if usage is None:
        chosen = sums.where(F.col("pending") >= least)
    else:
        chosen = sums.join(usage, SESSION, "left").where((F.col("pending") >= least) | (F.coalesce("usage", F.lit(0.0)) >= overflow))
    return blocks.join(chosen.select("session_id"), SESSION, "left_semi")


def snapped_view(blocks: DataFrame, archived: DataFrame) -> DataFrame:
    """Active archived blocks and the calls that made them, which are hidden."""
    return active(blocks).join(archived.select("session_id", "block_id"), ["session_id", "block_id"], "left_semi")


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("session_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.coalesce("active", F.lit(False))).alias("n_active"),
        F.sum(F.coalesce("compressed_tokens", F.lit(0))).cast("long").alias("compressed_tokens"),
        F.sum(quarter_tokens("summary")).cast("long").alias("summary_tokens"),
    )


def tier_counts(blocks: DataFrame) -> DataFrame:
    """Active blocks by tier, as ``T1:4 T2:1``."""
    counts = active(blocks).groupBy("session_id", "tier").agg(F.count("*").alias("n"))
    items = F.array_sort(F.collect_list(F.struct("tier", F.concat(F.lit("T"), "tier", F.lit(":"), "n").alias("s"))))
    return counts.groupBy("session_id").agg(F.array_join(F.transform(items, lambda x: x["s"]), " ").alias("tiers"))


def protected(messages: DataFrame, recent: int = 5, recent_tokens: int = 5000) -> DataFrame:
    """Marks the soft recent zone: the last ``recent`` messages, those within the last
    ``recent_tokens`` tokens, the last user message and results of compressing; large tool results
    stay out of the zone."""
    back = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("id"))
    from_end = F.row_number().over(back)
    tail = F.sum(token_estimate("text")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    last_user = F.max(F.when(F.col("role") == "user", F.struct("seq", "id"))).over(Window.partitionBy("session_id"))
    bulky = F.coalesce(F.col("tool_name").isin("decompress", "search_context", "read", "bash"), F.lit(False))
    zone = ((from_end <= recent) | (tail <= recent_tokens)) & ~bulky
    return messages.withColumn("protected", zone | F.struct("seq", "id").eqNullSafe(last_user) | F.col("tool_name").eqNullSafe("compress"))


def islands(rows: DataFrame, flag: Column) -> DataFrame:
    """Number the maximal runs of neighbouring rows with the same flag, in each session."""
    order = Window.partitionBy("session_id").orderBy("seq", "id")
    changed = F.coalesce((flag != F.lag(flag).over(order)).cast("int"), F.lit(1))
    return rows.withColumn("starts", changed).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def ranges(messages: DataFrame, members: DataFrame, recent: int = 5, recent_tokens: int = 5000) -> DataFrame:
    """Maximal runs of messages in view: compressible, or protected; oldest first by ``lo``."""
    open_rows = uncovered(protected(messages, recent, recent_tokens), members)
    # a covered message between two runs parts them
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "id"))
    placed = messages.select(*ROW, place.alias("place"))
    rows = open_rows.join(placed, ROW)
    order = Window.partitionBy("session_id").orderBy("place")
    starts = (F.col("protected") != F.lag("protected").over(order)) | (F.col("place") != F.lag("place").over(order) + 1)
    rows = rows.withColumn("starts", F.coalesce(starts.cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("session_id", "run").agg(
        F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.first("protected").alias("protected"), F.sum(token_estimate("text")).cast("long").alias("tokens"), F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("n")
    )


def top_range(ranges: DataFrame) -> DataFrame:
    """The largest compressible range of each session; ties go to the oldest."""
    open_ranges = ranges.where(~F.col("protected"))
    best = F.max_by(F.struct("lo", "hi", "tokens"), F.struct("tokens", (-F.col("lo")).alias("m")))
    return open_ranges.groupBy("session_id").agg(best.alias("r")).select("session_id", "r.lo", "r.hi", "r.tokens")
