"""Compressing ranges into blocks, promoting tiers and restoring what blocks hold.

State changes are functional: tables in, new tables out. A block knows its members by their ids, so
that what a range leaves out, protected messages, stays in view. A range may consume blocks that lie
wholly inside it; they turn inactive and their members go over to the new block. Where the semantics
of ranges aren't given by the data they are ours: a range below ``least_chars`` is an error, protected
messages drop out of a range with a warning, and a range bounded by blocks makes a block one tier
above the highest it consumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import head_preview, token_estimate
from ..operators.blocks import active, uncovered_tokens

MOST_TIERS = 3
INLINE_CHARS = 2000
#: Turns in a bucket of a range join.
SPAN = 64


def in_ranges(ranges: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """``ranges`` (session_id, lo, hi) with the ``rows`` whose ``at`` lies in them. Ranges are cut into
    buckets of turns, so that a row meets the ranges of its own bucket and not all of its session."""
    bucket = lambda c: F.floor(F.col(c) / SPAN)
    cut = ranges.select("session_id", "lo", "hi").where("lo <= hi").withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    return cut.join(rows.withColumn("bucket", bucket(at)), ["session_id", "bucket"]).where(F.col(at).between(F.col("lo"), F.col("hi"))).drop("bucket")


def compress_ranges(ranges: DataFrame, messages: DataFrame, blocks: DataFrame, members: DataFrame, least_chars: int = 5000) -> DataFrame:
    """``ranges`` (session_id, lo, hi, by_blocks, topic, summary) -> what each makes.

    Columns: the range, n_messages, n_protected, chars, tokens, consumed (block ids), member_ids, tier,
    error, and the session's tokens before and after. ``messages`` has a ``protected`` flag.
    """
    key = ["session_id", "lo", "hi"]
    # what a range reclaims is in view only where no active block covers it yet
    seen = members.where(F.coalesce("active", F.lit(False))).select("session_id", "id").distinct().withColumn("seen", F.lit(True))
    counted = messages.select("session_id", "id", "seq", "protected", F.length("text").alias("size"), token_estimate("text").alias("t"))
    inside = in_ranges(ranges, counted, "seq").join(seen, ["session_id", "id"], "left")
    taken = lambda c: F.when(~F.col("protected"), c)
    held = inside.groupBy(*key).agg(
        F.count_if(~F.col("protected")).alias("n_messages"),
        F.count_if("protected").alias("n_protected"),
        F.sum(taken(F.col("size"))).cast("long").alias("chars"),
        F.sum(taken(F.col("t"))).cast("long").alias("tokens"),
        F.sum(F.when(F.col("seen").isNull(), taken(F.col("t")))).cast("long").alias("reclaimed"),
        F.array_sort(F.collect_list(taken(F.struct("seq", "id")))).alias("own"),
    )
    b = active(blocks).select("session_id", "block_id", "tier", "member_ids", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    eaten = in_ranges(ranges, b, "b_lo").where("b_hi <= hi")
    listed = F.array_sort(F.collect_list(F.struct("block_id", "member_ids")))
    eaten = eaten.groupBy(*key).agg(listed.alias("eaten"), F.max("tier").alias("top_tier"))
    out = ranges.join(held, key, "left").join(eaten, key, "left").na.fill(0, ["n_messages", "n_protected", "chars", "tokens", "reclaimed"])
    tier = F.when(F.col("by_blocks"), F.least(F.lit(MOST_TIERS), F.coalesce("top_tier", F.lit(0)) + 1)).otherwise(1)
    error = F.when(F.col("n_messages") == 0, "empty range").when(F.col("chars") < least_chars, "range too short")
    none = F.array().cast("array<string>")
    theirs = F.flatten(F.transform("eaten", lambda x: x["member_ids"]))
    ids = F.array_distinct(F.concat(F.coalesce(F.transform("own", lambda x: x["id"]), none), F.coalesce(theirs, none)))
    out = out.withColumn("consumed", F.coalesce(F.transform("eaten", lambda x: x["block_id"]), none)).withColumn("member_ids", ids)
    out = out.withColumn("tier", tier.cast("long")).withColumn("error", error).drop("top_tier", "own", "eaten")
    before = uncovered_tokens(messages, members).withColumnRenamed("tokens", "before")
    after = F.greatest(F.lit(0), F.col("before") - F.when(F.col("error").isNull(), F.col("reclaimed")).otherwise(0))
    return out.join(before, "session_id", "left").withColumn("after", after)


def apply_compression(blocks: DataFrame, made: DataFrame) -> DataFrame:
    """The next blocks table: consumed blocks inactive, and a new block for each range without error."""
    good = made.where("error is null")
    eaten = good.select("session_id", F.explode("consumed").alias("block_id")).distinct().withColumn("eaten", F.lit(True))
    kept = blocks.join(eaten, ["session_id", "block_id"], "left").withColumn("active", F.coalesce("active", F.lit(False)) & F.col("eaten").isNull()).select(*blocks.columns)
    last = blocks.groupBy("session_id").agg(F.max("pos").alias("last"), F.max("created_at").alias("now"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("lo", "hi"))
    new = good.join(last, "session_id", "left").withColumn("pos", F.coalesce("last", F.lit(-1)) + n)
    new = new.select(
        "session_id", F.concat(F.lit("b"), F.col("pos") + 1).alias("block_id"), "pos", "tier", "topic", "summary", "lo", "hi",
        F.col("tokens").alias("compressed_tokens"), (F.coalesce("now", F.lit(0)) + n).alias("created_at"), F.lit(True).alias("active"),
        "member_ids", F.col("consumed").alias("inner_ids"),
    )
    typed = (F.col(c) if c in ("member_ids", "inner_ids") else F.col(c).cast(kept.schema[c].dataType) for c in kept.columns)
    return kept.unionByName(new.select(*typed))


def nested_blocks(wanted: DataFrame, contains: DataFrame) -> DataFrame:
    """All blocks in ``wanted`` (session_id, block_id), through ``contains`` (session_id, block_id,
    inner_id), level by level until a level brings nothing new: (session_id, root, block_id)."""
    found = wanted.select("session_id", F.col("block_id").alias("root"), "block_id").distinct()
    level = found
    while True:
        level = level.join(contains, ["session_id", "block_id"]).select("session_id", "root", F.col("inner_id").alias("block_id")).distinct()
        level = level.join(found, ["session_id", "root", "block_id"], "left_anti")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def restore_blocks(wanted: DataFrame, blocks: DataFrame, messages: DataFrame, full: bool = False) -> DataFrame:
    """``wanted`` (session_id, block_id, and perhaps inline, to_file) -> what each holds, in order, as one
    text: its messages, and of the blocks it has consumed their summaries, one tier up; with ``full``
    the messages of all blocks in it, however deep, instead."""
    asked = wanted.select("session_id", F.col("block_id").alias("root")).distinct()
    contains = blocks.select("session_id", "block_id", F.explode("inner_ids").alias("inner_id"))
    own = blocks.select("session_id", "block_id", F.explode("member_ids").alias("id"))
    if full:
        inside = nested_blocks(wanted, contains)
        ids = inside.join(own, ["session_id", "block_id"]).select("session_id", "root", "id").distinct()
    else:
        inner = asked.join(contains.withColumnRenamed("block_id", "root"), ["session_id", "root"])
        theirs = inner.join(own.withColumnRenamed("block_id", "inner_id"), ["session_id", "inner_id"]).select("session_id", "root", "id")
        ids = asked.join(own.withColumnRenamed("block_id", "root"), ["session_id", "root"]).join(theirs, ["session_id", "root", "id"], "left_anti")
    said = ids.join(messages.select("session_id", "id", "seq", "role", "text"), ["session_id", "id"])
    items = said.select("session_id", "root", F.col("seq").alias("place"), "id", F.concat("role", F.lit(": "), "text").alias("s"))
    if not full:
        sums = inner.join(blocks.select("session_id", F.col("block_id").alias("inner_id"), "tier", "summary", "lo"), ["session_id", "inner_id"])
        line = F.concat(F.lit("[block "), "inner_id", F.lit(" t"), "tier", F.lit("] "), F.coalesce("summary", F.lit("")))
        items = items.unionByName(sums.select("session_id", "root", F.col("lo").alias("place"), F.col("inner_id").alias("id"), line.alias("s")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "s")))
    out = items.groupBy("session_id", F.col("root").alias("block_id")).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("text"), F.count("*").alias("n"))
    # blocks go to a file unless they are wanted inline
    inline = F.coalesce("inline", F.lit(False)) & F.col("to_file").isNull()
    return _asked(out, wanted, "block_id").withColumn("mode", F.when(inline, "inline").otherwise("file"))


def _asked(out: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``out`` with what was asked for: ``inline`` and ``to_file``, null where nothing was."""
    given = wanted.select("session_id", key, *(F.col(c) if c in wanted.columns else F.lit(None).cast(t).alias(c) for c, t in (("inline", "boolean"), ("to_file", "string"))))
    return out.join(given.dropDuplicates(["session_id", key]), ["session_id", key], "left")


def restore_messages(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """``wanted`` (session_id, ref, and perhaps inline, to_file) -> the original text of each, from the
    full log; a long one goes to a file, whatever ``inline`` says, and shows its head."""
    out = wanted.select("session_id", "ref").distinct().join(messages.select("session_id", "ref", "id", "text"), ["session_id", "ref"])
    filed = F.col("to_file").isNotNull() | ~F.coalesce("inline", F.lit(True)) | (F.length("text") >= INLINE_CHARS)
    out = _asked(out, wanted, "ref").withColumn("mode", F.when(filed, "file").otherwise("inline"))
    return out.withColumn("shown", F.when(F.col("mode") == "file", head_preview("text")).otherwise(F.col("text")))
