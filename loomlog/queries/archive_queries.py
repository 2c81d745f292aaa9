"""Queries over archives of blocks: sections, frames, batches, caps and garbage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions.layout import Grid
from ..operators import archive as A
from ..registry import query
from .block_queries import SNAPSHOTS, tables
from .text_queries import folded_sql

GRID, PRICE, MOST = Grid(30, 10), 3293, 3
PAGE = GRID.capacity
WITH = f"WITH {model.SQL}, {SNAPSHOTS}"
SECTION = "'[block ' || block_id || ' t' || tier || ']' || CASE WHEN coalesce(topic, '') <> '' THEN ' ' || topic ELSE '' END || chr(10) || body"
# every active block is a batch; its pages are hashed
FRAMES = f"""raw AS (SELECT session_id, block_id, pos AS batch, {SECTION} AS s FROM snaps),
sect AS (SELECT session_id, block_id, batch, {folded_sql('s')} AS s FROM raw),
pages AS (SELECT session_id, block_id, batch, page, substring(s, page * {PAGE} + 1, {PAGE}) AS body FROM (SELECT *, unnest(range(0, (length(s) + {PAGE - 1}) // {PAGE})) AS page FROM sect) p),
named AS (SELECT session_id, block_id, batch, page AS pos, left(sha256(body), 32) AS sha, octet_length(encode(body)) AS bytes FROM pages),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY batch DESC, pos DESC) AS r FROM named) x WHERE r <= {MOST})"""


def snapshots(spark, sf_dir):
    messages, blocks, members = tables(spark, sf_dir)
    return A.block_snapshots(blocks, members, messages)


def pages(spark, sf_dir):
    """(session_id, block_id, batch, pos, sha, bytes, body)"""
    snaps = snapshots(spark, sf_dir)
    key = F.struct("session_id", "block_id", F.col("pos").alias("batch"))
    one = A.serialize_blocks(snaps.withColumn("session_id", key))
    frames = A.to_frames(one, GRID, PRICE)
    return frames.select("session_id.*", F.col("page").alias("pos"), "sha", "bytes", "tokens", "body")


def batches(spark, sf_dir):
    rows = pages(spark, sf_dir).groupBy("session_id", "block_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "sha"))).alias("p"))
    return rows.select("session_id", "batch", F.array("block_id").alias("block_ids"), F.transform("p", lambda x: x["sha"]).alias("shas"))


@query(f"{WITH} SELECT session_id, string_agg({SECTION}, chr(10) || chr(10) ORDER BY created_at, pos) AS archive FROM snaps GROUP BY session_id")
def serialize_blocks(spark, sf_dir):
    return A.serialize_blocks(snapshots(spark, sf_dir))


@query(f"{WITH}, {FRAMES} SELECT session_id, batch, pos, sha, CAST(bytes AS BIGINT) AS bytes FROM named")
def frames_from_batches(spark, sf_dir):
    frames = A.new_frames(pages(spark, sf_dir)).select("sha", "bytes", "tokens")
    return A.frames_of_batches(batches(spark, sf_dir), frames).select("session_id", "batch", F.col("pos").cast("long").alias("pos"), "sha", "bytes")


@query(f"{WITH}, {FRAMES} SELECT DISTINCT sha, CAST(bytes AS BIGINT) AS bytes FROM named WHERE sha NOT IN (SELECT sha FROM named WHERE batch = 0)")
def frames_dedupe(spark, sf_dir):
    """Frames that a store which has those of the first batches still needs."""
    rows = pages(spark, sf_dir)
    return A.new_frames(rows, rows.where("batch = 0").select("sha").distinct()).select("sha", "bytes")


@query(f"{WITH}, {FRAMES} SELECT session_id, count(*) AS n_frames, CAST(count(*) * {PRICE} AS BIGINT) AS tokens FROM named GROUP BY session_id")
def frame_tokens(spark, sf_dir):
    return pages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n_frames"), F.sum("tokens").cast("long").alias("tokens"))


@query(f"{WITH}, {FRAMES} SELECT session_id, batch, pos, sha FROM kept")
def frames_capped(spark, sf_dir):
    return A.cap_frames(pages(spark, sf_dir), MOST).select("session_id", "batch", "pos", "sha")


@query(f"{WITH}, {FRAMES} SELECT n.session_id, n.batch, string_agg(n.sha, ',' ORDER BY n.pos) AS shas FROM named n WHERE EXISTS (SELECT 1 FROM kept k WHERE k.session_id = n.session_id AND k.sha = n.sha) GROUP BY n.session_id, n.batch")
def batches_capped(spark, sf_dir):
    kept = A.cap_frames(pages(spark, sf_dir), MOST)
    return A.cap_batches(batches(spark, sf_dir), kept).select("session_id", "batch", F.array_join("shas", ",").alias("shas"))


@query(f"{WITH}, {FRAMES} SELECT DISTINCT session_id, batch FROM named WHERE batch % 2 = 0")
def gc_batches(spark, sf_dir):
    """Blocks of odd batches have been consumed."""
    living = model.blocks(spark, sf_dir).withColumn("active", F.col("active") & (F.col("pos") % 2 == 0))
    return A.collect_garbage(batches(spark, sf_dir), living).select("session_id", "batch")


@query(f"{WITH}, {FRAMES} SELECT session_id, count(*) AS n_frames, string_agg(sha, ',' ORDER BY batch, pos) AS shas, 'archived frames, oldest first: ' || count(*) AS header FROM kept GROUP BY session_id")
def attachment(spark, sf_dir):
    out = A.attachment(A.cap_frames(pages(spark, sf_dir), MOST))
    return out.select("session_id", "n_frames", F.array_join("shas", ",").alias("shas"), "header")


@query(f"{WITH}, {FRAMES} SELECT session_id, batch, any_value(block_id) AS block_ids, count(*) AS n_frames, CAST(count(*) * {PRICE} AS BIGINT) AS tokens FROM named WHERE batch % 4 <> 0 GROUP BY session_id, batch")
def archive_batches(spark, sf_dir):
    """The batches that archiving appends for blocks that aren't archived yet."""
    fresh = pages(spark, sf_dir).where(F.col("batch") % 4 != 0)
    out = fresh.groupBy("session_id", "batch").agg(F.array_join(F.collect_set("block_id"), ",").alias("block_ids"), F.count("*").alias("n_frames"), F.sum("tokens").cast("long").alias("tokens"))
    return out


@query(f"{WITH}, {FRAMES} SELECT DISTINCT n.session_id, n.block_id FROM named n WHERE NOT EXISTS (SELECT 1 FROM kept k JOIN named m ON m.session_id = k.session_id AND m.sha = k.sha WHERE m.session_id = n.session_id AND m.block_id = n.block_id)")
def lost_blocks(spark, sf_dir):
    """Archived blocks that the cap has left without a frame."""
    rows = pages(spark, sf_dir)
    held = A.cap_batches(batches(spark, sf_dir), A.cap_frames(rows, MOST)).join(batches(spark, sf_dir).select("session_id", "batch", "block_ids"), ["session_id", "batch"])
    return A.lost_blocks(rows.select("session_id", "block_id").distinct(), held)


@query("SELECT user_id AS run_id, CAST(round(sum(value), 4) AS DOUBLE) AS used FROM events GROUP BY user_id HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) >= 3600000000 AND round(sum(value), 4) >= 50")
def idle_candidates(spark, sf_dir):
    """Sessions without activity for an hour whose use is at least 50."""
    rows = model.read(spark, sf_dir, "events")
    now = rows.agg(F.unix_micros(F.max("ts"))).scalar()
    out = rows.groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("last"), F.round(F.sum("value"), 4).alias("used"))
    return out.where((now - F.unix_micros("last") >= 3_600_000_000) & (F.col("used") >= 50)).select("run_id", "used")
