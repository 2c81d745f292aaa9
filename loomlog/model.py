"""Tables of the engine, and how the test tables stand in for them.

* ``core``: session_id, id, seq, role, content_type, tool_name, tool_call_id, text - one row a message
* ``blocks``: session_id, block_id, pos, tier, topic, summary, lo, hi, compressed_tokens, created_at, active,
  member_ids, inner_ids - the ids of the messages that a block covers, in order, and of the blocks it has consumed
* ``members``: session_id, block_id, pos, id, active, tier - a row for each message that a block covers
* ``frames``: sha, bytes, tokens; ``batches``: batch, block_ids, shas, tokens, archived_at
* ``stream``: run_id, ts, event_id, line - events of delegated runs as NDJSON lines
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import TRIMMED, quarter_tokens, trimmed

ENTRY_SCHEMA = "type string, id string, parentId string, timestamp string, customType string, content string, message string"
CORE_COLUMNS = ("session_id", "id", "seq", "role", "content_type", "tool_name", "tool_call_id", "text")
CONTENT = "array<struct<type: string, text: string, id: string, name: string, arguments: string>>"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; times without a zone are UTC, as sessions here are."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.withColumns({n: F.col(n).cast("timestamp") for n, kind in rows.dtypes if kind == "timestamp_ntz"})


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as canonical messages: unknown roles speak as the user, blank assistant
    turns are dropped."""
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
        F.lit("text").alias("content_type"),
        F.lit(None).cast("string").alias("tool_name"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.where((F.col("role") != "assistant") | (trimmed("text") != ""))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each two turns, of which every seventh is left out, as protected messages are; every
    third block is inactive."""
    step = F.floor(F.col("seq") / 2)
    taken = F.col("seq") % 7 != 3
    ids = F.array_sort(F.collect_list(F.when(taken, F.struct("seq", "id"))))
    out = core(spark, sf_dir).groupBy("session_id", step.alias("created_at")).agg(
        F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum(F.when(taken, quarter_tokens("text")).otherwise(0)).alias("compressed_tokens"), F.min_by("text", "seq").alias("opening"), ids.alias("ids")
    )
    return out.select(
        "session_id",
        F.concat(F.lit("b"), F.col("created_at") + 1).alias("block_id"),
        F.col("created_at").alias("pos"),
        F.lit(1).cast("long").alias("tier"),
        F.when(F.col("created_at") % 2 == 0, F.concat(F.lit("topic "), "created_at")).alias("topic"),
        F.substring("opening", 1, 120).alias("summary"),
        "lo",
        "hi",
        "compressed_tokens",
        "created_at",
        (F.col("created_at") % 3 != 2).alias("active"),
        F.transform("ids", lambda x: x["id"]).alias("member_ids"),
        F.array().cast("array<string>").alias("inner_ids"),
    )


def members(blocks: DataFrame) -> DataFrame:
    """The messages that each block covers."""
    return blocks.select("session_id", "block_id", "pos", F.explode("member_ids").alias("id"), "active", "tier")


#: DuckDB forms of the tables above, for oracle SQL.
SQL = f"""
core AS (
  SELECT conv_id AS session_id, conv_id || '-' || turn AS id, turn AS seq,
    CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, 'text' AS content_type, coalesce(text, '') AS text
  FROM conversations WHERE coalesce(role, '') <> 'assistant' OR trim(coalesce(text, ''), '{TRIMMED}') <> ''
),
blk AS (
  SELECT session_id, 'b' || (seq // 2 + 1) AS block_id, seq // 2 AS pos, CAST(1 AS BIGINT) AS tier,
    CASE WHEN (seq // 2) % 2 = 0 THEN 'topic ' || (seq // 2) END AS topic, left(arg_min(text, seq), 120) AS summary,
    min(seq) AS lo, max(seq) AS hi, CAST(sum(CASE WHEN seq % 7 <> 3 THEN (length(text) + 3) // 4 ELSE 0 END) AS BIGINT) AS compressed_tokens, seq // 2 AS created_at, (seq // 2) % 3 <> 2 AS active
  FROM core GROUP BY session_id, seq // 2
),
mem AS (
  SELECT b.session_id, block_id, pos, c.id, c.seq, active, tier FROM blk b JOIN core c ON b.session_id = c.session_id AND c.seq BETWEEN lo AND hi WHERE c.seq % 7 <> 3
)"""
#: Token estimate of ``{}`` in DuckDB.
TOKENS_SQL = r"""CAST(length({0}) - length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]', '', 'g'))
  + (length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]', '', 'g')) + 3) // 4 AS BIGINT)"""


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(column)
