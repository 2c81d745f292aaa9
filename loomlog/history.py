"""The library's front: sessions with their blocks and archives, and what can be asked of them.

A :class:`History` is a set of tables and never changes; operations that change state return the
next one, whose state tables they have written to the shared folder, so that plans stay short and a
lost executor costs no more than a step. All of it works on many sessions at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model
from .functions.layout import SHAPES, frame_price, grid_of, shape_for
from .functions.text import parse_block_id
from .operators import archive as A
from .operators import blocks as B
from .operators import search as S
from .operators import status as R
from .operators.messages import assign_refs
from .plans import history as H
from .plans.turn import run_turn
from .session import settled


@dataclass(frozen=True)
class History:
    """``messages`` and ``blocks`` as in :mod:`loomlog.model`; ``batches`` (session_id, batch,
    block_ids, shas) and ``frames`` (sha, bytes, tokens) where there are archives."""

    messages: DataFrame
    blocks: DataFrame
    batches: DataFrame | None = None
    frames: DataFrame | None = None
    limit: int = 150_000
    recent: int = 5
    recent_tokens: int = 5_000
    hot_blocks: int = 6
    snap_threshold: int = 8_000
    most_frames: int = 16

    @cached_property
    def members(self) -> DataFrame:
        return model.members(self.blocks)

    @cached_property
    def refs(self) -> DataFrame:
        return assign_refs(self.messages)

    def settled(self) -> History:
        """The same with its state tables written and read again."""
        tables = {name: getattr(self, name) for name in ("blocks", "batches", "frames")}
        done = {name: settled(table, f"state-{name}") for name, table in tables.items() if table is not None}
        return replace(self, **done)

    def turn(self, hidden_calls: DataFrame | None = None, shown: DataFrame | None = None) -> dict[str, DataFrame]:
        """Visible messages, ranges and nudges of a turn, and which nudges have been shown (see
        :func:`plans.turn.run_turn`)."""
        return run_turn(self.messages, self.blocks, self.members, self.limit, self.recent, self.recent_tokens, hidden_calls, shown)

    def search(self, words: str, limit: int = 10, blocks_only: bool = False) -> DataFrame:
        """The best folded documents of each session for the words of a query."""
        terms = list(dict.fromkeys(re.findall(S.TERM, words.lower())))
        docs = S.search_docs(self.messages, self.blocks, self.members)
        docs = docs.where("kind = 'block'") if blocks_only else docs
        return S.top_k(S.bm25(docs, terms), limit) if terms else S.top_k(S.bm25(docs.limit(0), [""]), limit)

    def compress(self, ranges: DataFrame, least_chars: int = 5_000) -> tuple[History, DataFrame]:
        """The next history, and a report for each range (see :func:`plans.history.compress_ranges`)."""
        rows = B.protected(self.messages, self.recent, self.recent_tokens).withColumn("protected", F.coalesce("protected", F.lit(False)))
        made = H.compress_ranges(ranges, rows, self.blocks, self.members, least_chars)
        return replace(self, blocks=H.apply_compression(self.blocks, made)).settled(), made

    def restore(self, targets: DataFrame, full: bool = False) -> DataFrame:
        """``targets`` (session_id, target, and perhaps inline, to_file) -> found ('message', 'block' or
        'none'), text and mode; a target is looked up as a message's reference first, then read as a block
        id, and one that is neither gets the ids of the session's active blocks as its text. ``full``
        restores the messages of all blocks in a block, too."""
        wanted = targets.dropDuplicates(["session_id", "target"])
        by_ref = H.restore_messages(wanted.withColumnRenamed("target", "ref"), self.refs).select("session_id", F.col("ref").alias("target"), F.lit("message").alias("found"), "text", "mode")
        rest = wanted.join(by_ref.select("session_id", "target"), ["session_id", "target"], "left_anti").withColumn("block_id", parse_block_id("target"))
        texts = H.restore_blocks(rest.where("block_id is not null"), self.blocks, self.messages, full).select("session_id", "block_id", "text", "mode")
        by_id = rest.select("session_id", "target", "block_id").join(texts, ["session_id", "block_id"]).select("session_id", "target", F.lit("block").alias("found"), "text", "mode")
        lost = rest.select("session_id", "target").join(by_id.select("session_id", "target"), ["session_id", "target"], "left_anti")
        ids = B.active(self.blocks).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id"))).alias("b"))
        listed = F.array_join(F.transform("b", lambda x: x["block_id"]), ", ")
        none = lost.join(ids, "session_id", "left").select("session_id", "target", F.lit("none").alias("found"), F.coalesce(listed, F.lit("")).alias("text"), F.lit("inline").alias("mode"))
        return by_ref.unionByName(by_id).unionByName(none)

    def status(self, sort: str = "size", tool: str | None = None, limit: int = 30) -> DataFrame:
        """Messages in view."""
        return R.listing(B.uncovered(self.refs, self.members), sort, tool, limit)

    def overview(self) -> DataFrame:
        usage = B.uncovered_tokens(self.messages, self.members)
        percent = F.floor(F.col("tokens") * 100.0 / self.limit + 0.5) if self.limit > 0 else F.lit(0)
        return usage.withColumn("percent", percent.cast("long")).join(B.totals(self.blocks), "session_id", "left").join(B.tier_counts(self.blocks), "session_id", "left").na.fill(0)

    @cached_property
    def archived(self) -> DataFrame:
        if self.batches is None:
            return self.blocks.select("session_id", "block_id").limit(0)
        return self.batches.select("session_id", F.explode("block_ids").alias("block_id")).distinct()

    def candidates(self) -> DataFrame:
        """Cold blocks that aren't archived, of sessions where their summaries add up."""
        return B.gate(B.unsnapped(B.cold(self.blocks, self.hot_blocks), self.archived), self.snap_threshold)

    def archive(self, blocks: DataFrame | None = None, shape: str = "8on22-bw", family: str = "unknown", fixed: bool = False) -> History:
        """Append a batch of pages for each session's candidates, and keep the newest frames. Pages have
        ``shape``, or the silver one where a session's text needs it, unless ``fixed``."""
        chosen = self.candidates() if blocks is None else blocks
        snapshots = A.block_snapshots(chosen, self.members, self.messages)
        texts = A.serialize_blocks(snapshots).withColumn("shape", F.lit(shape) if fixed else shape_for(F.col("archive"), shape))
        pages = None
        for name in dict.fromkeys((shape, "silver16-bw")):
            size = next(s[8] for s in SHAPES if s[0] == name)
            price = frame_price(F.lit(family), F.lit(size))
            made = A.to_frames(texts.where(F.col("shape") == name), grid_of(name), 0).withColumn("tokens", price)
            pages = made if pages is None else pages.unionByName(made)
        last = F.lit(-1) if self.batches is None else None
        ids = snapshots.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "pos", "block_id"))), lambda x: x["block_id"]).alias("block_ids"))
        shas = pages.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "sha"))), lambda x: x["sha"]).alias("shas"))
        new = ids.join(shas, "session_id")
        if last is None:
            tops = self.batches.groupBy("session_id").agg(F.max("batch").alias("top"))
            new = new.join(tops, "session_id", "left").withColumn("batch", F.coalesce("top", F.lit(-1)) + 1).drop("top")
        else:
            new = new.withColumn("batch", F.lit(0))
        new = new.select("session_id", F.col("batch").cast("long").alias("batch"), "block_ids", "shas")
        batches = new if self.batches is None else self.batches.unionByName(new)
        fresh = A.new_frames(pages, self.frames).select("sha", "bytes", "tokens")
        frames = fresh if self.frames is None else self.frames.unionByName(fresh)
        return replace(self, batches=batches, frames=frames).settled()._capped()

    def _capped(self) -> History:
        kept = A.cap_frames(A.frames_of_batches(self.batches, self.frames), self.most_frames)
        held = A.cap_batches(self.batches, kept).join(self.batches.select("session_id", "batch", "block_ids"), ["session_id", "batch"])
        return replace(self, batches=held.select("session_id", "batch", "block_ids", "shas"), frames=self.frames.join(kept.select("sha").distinct(), "sha", "left_semi")).settled()

    def collect_garbage(self) -> History:
        """Drop batches without an active block."""
        return replace(self, batches=A.collect_garbage(self.batches, self.blocks)).settled()._capped()

    def attachment(self, listing: DataFrame | None = None) -> DataFrame:
        """The frames' message; frames whose file isn't in ``listing`` (paths of the store) are skipped."""
        return A.attachment(A.cap_frames(A.frames_of_batches(self.batches, self.frames), self.most_frames), listing)
