"""Archives: transcripts and blocks as text, pages as frames, batches, the cap and the collection of garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import Grid, page_array
from ..functions.text import DIM_OFF, DIM_ON, content_sha, trimmed, truncate_head_tail
from .status import present_frames

SCOPES = {"user": "¶user:", "ai": "¶ai:", "think": "¶think:", "call": "¶call:"}


def _undimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x0e\x0f]", "")


def call_key() -> Column:
    return F.coalesce("tool_call_id", "id")


def call_results(messages: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The last result text for each call; empty results don't count."""
    results = messages.where((F.col("role") == "tool") & (F.col("content_type") == "tool-result") & (F.col("text") != ""))
    return results.groupBy(*by, call_key().alias("key")).agg(F.max_by("text", F.struct("seq", "id")).alias("result"), F.count("*").alias("n_results"))


def call_result_pairs(messages: DataFrame) -> DataFrame:
    """Each call with its result, if there is one."""
    calls = messages.where(F.col("content_type") == "tool-call").withColumn("key", call_key())
    return calls.join(call_results(messages), ["session_id", "key"], "left")


def serialize(messages: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(``by``, transcript): scoped sections in order; neighbours of one scope run together.

    A result stands under its call; one that comes before its call, or has none, stands alone as
    well. Other rows say nothing. ``by`` names the group that is one transcript.
    """
    rows = messages.withColumn("key", call_key()).withColumn("place", F.struct("seq", "id"))
    results = call_results(messages, by).select(*by, "key", "result")
    first_call = rows.where((F.col("role") == "assistant") & (F.col("content_type") == "tool-call")).groupBy(*by, "key").agg(F.min("place").alias("call_at"))
    rows = rows.join(results, [*by, "key"], "left").join(first_call, [*by, "key"], "left")
    out = F.concat(F.lit(f"<out>\n{DIM_ON}"), truncate_head_tail(_undimmed(F.col("result"))), F.lit(f"{DIM_OFF}\n</out>"))
    said = _undimmed(F.col("text"))
    call = F.concat(F.coalesce("tool_name", F.lit("tool")), F.lit("("), truncate_head_tail(said), F.lit(")"))
    is_ = lambda role, kind: (F.col("role") == role) & (F.col("content_type") == kind)
    blank = trimmed("text") == ""
    part = lambda scope, text: F.struct(F.lit(SCOPES[scope]).alias("scope"), text.alias("text"))
    piece = (
        F.when(is_("user", "text") & (F.col("text") != ""), part("user", said))
        .when(is_("assistant", "text") & ~blank, part("ai", said))
        .when(is_("assistant", "reasoning") & ~blank, part("think", said))
        .when(is_("assistant", "tool-call"), part("call", F.when(F.col("result").isNull(), call).otherwise(F.concat(call, F.lit("\n"), out))))
        .when(is_("tool", "tool-result") & F.col("result").isNotNull() & (F.col("call_at").isNull() | (F.col("call_at") > F.col("place"))), part("call", F.concat(F.lit("\n"), out)))
    )
    rows = rows.withColumn("piece", piece).where("piece is not null").select(*by, "place", "piece.*")
    order = Window.partitionBy(*by).orderBy("place")
    before, text_before = F.lag("scope").over(order), F.lag("text").over(order)
    same = F.col("scope").eqNullSafe(before)
    joint = F.when(before.isNull(), "").when(~same, "\n\n").when(text_before.endswith("\n") | F.col("text").startswith("\n"), "").otherwise("\n")
    rows = rows.withColumn("s", F.concat(joint, F.when(same, "").otherwise(F.col("scope")), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "s")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("transcript"))


def serialize_blocks(snapshots: DataFrame) -> DataFrame:
    """(session_id, archive): a section for each block, in order."""
    head = F.concat(F.lit("[block "), "block_id", F.lit(" t"), "tier", F.lit("]"), F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit(" "), "topic")).otherwise(""))
    rows = snapshots.select("session_id", F.struct("created_at", "pos").alias("place"), F.concat(head, F.lit("\n"), "body").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "s")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("archive"))


def block_snapshots(blocks: DataFrame, members: DataFrame, messages: DataFrame) -> DataFrame:
    """Active blocks with the transcript of their members, or their summary where that is blank."""
    by = ("session_id", "block_id")
    source = serialize(members.select(*by, "id").join(messages, ["session_id", "id"]), by)
    out = blocks.where(F.coalesce("active", F.lit(False))).join(source, list(by), "left")
    said = trimmed(F.coalesce("transcript", F.lit("")))
    return out.withColumn("body", F.when(said != "", said).otherwise(trimmed("summary"))).drop("transcript")


def to_frames(archives: DataFrame, grid: Grid, tokens: int, text: str = "archive", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Archive texts folded and cut into pages of a grid, as frames: (``keys``, page, sha, bytes, tokens, body)."""
    pages = archives.select(*keys, F.posexplode(page_array(F.col(text), grid)).alias("page", "body"))
    return pages.select(*keys, F.col("page").cast("long").alias("page"), content_sha("body").alias("sha"), F.octet_length("body").cast("long").alias("bytes"), F.lit(tokens).cast("long").alias("tokens"), "body")


def new_frames(frames: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Frames whose content isn't stored yet, each once: what a content-addressed store writes."""
    once = frames.groupBy("sha").agg(F.first("bytes").alias("bytes"), F.first("tokens").alias("tokens"), F.first("body").alias("body"))
    return once if store is None else once.join(store.select("sha"), "sha", "left_anti")


def frames_of_batches(batches: DataFrame, frames: DataFrame) -> DataFrame:
    """Batches (session_id, batch, shas) -> their frames in order; a hash that two batches name
    stands twice, one without a frame not at all."""
    named = batches.select("session_id", "batch", F.posexplode("shas").alias("pos", "sha"))
    return named.join(frames, "sha")


def cap_frames(listed: DataFrame, most: int = 16) -> DataFrame:
    """The last ``most`` frames of each session."""
    back = Window.partitionBy("session_id").orderBy(F.desc("batch"), F.desc("pos"))
    return listed.withColumn("from_end", F.row_number().over(back)).where(F.col("from_end") <= most).drop("from_end")


def cap_batches(batches: DataFrame, kept: DataFrame) -> DataFrame:
    """Batches with the hashes that were kept; those left empty go."""
    shas = batches.select("session_id", "batch", F.posexplode("shas").alias("pos", "sha"))
    shas = shas.join(kept.select("session_id", "sha").distinct(), ["session_id", "sha"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sha")))
    return shas.groupBy("session_id", "batch").agg(F.transform(ordered, lambda x: x["sha"]).alias("shas"))


def collect_garbage(batches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Batches with at least one block that is active."""
    living = blocks.where(F.coalesce("active", F.lit(False))).select("session_id", "block_id")
    live = batches.select("session_id", "batch", F.explode("block_ids").alias("block_id")).join(living, ["session_id", "block_id"], "left_semi")
    return batches.join(live.select("session_id", "batch").distinct(), ["session_id", "batch"], "left_semi")


def lost_blocks(archived: DataFrame, batches: DataFrame) -> DataFrame:
    """Archived blocks whose frames the cap has evicted."""
    held = batches.select("session_id", F.explode("block_ids").alias("block_id"))
    return archived.join(held, ["session_id", "block_id"], "left_anti")


def attachment(kept: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The message that brings the frames back: a header that counts them, and the hashes of those whose
    file is in ``listing`` (paths; without one, of all), oldest first. A session without any has none."""
    counts = kept.groupBy("session_id").agg(F.count("*").alias("n_frames"))
    there = kept if listing is None else present_frames(kept, listing)
    ordered = F.array_sort(F.collect_list(F.struct("batch", "pos", "sha")))
    out = there.groupBy("session_id").agg(F.transform(ordered, lambda x: x["sha"]).alias("shas")).join(counts, "session_id")
    return out.withColumn("header", F.concat(F.lit("archived frames, oldest first: "), "n_frames"))
