"""Queries of reports and of the rules around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import messages as M
from ..operators import status as R
from ..registry import query
from .event_queries import base
from .message_queries import ENTRIES_SQL, entries

TOK = model.tokens_sql("text")


def core(spark, sf_dir):
    return M.to_core(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, l AS (SELECT session_id, id, {TOK} AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY {TOK} DESC, seq) AS rank FROM pc WHERE tool_name = 'bash') SELECT session_id, rank, id, tokens FROM l WHERE rank <= 3")
def status_by_tool(spark, sf_dir):
    """The largest messages of one tool."""
    return R.listing(core(spark, sf_dir), "size", "bash", 3).select("session_id", "rank", "id", "tokens")


@query(f"WITH {ENTRIES_SQL}, l AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rank FROM pc WHERE id NOT LIKE '%#%') SELECT session_id, rank, id FROM l WHERE rank <= 5")
def status_by_age(spark, sf_dir):
    rows = core(spark, sf_dir).where(~F.col("id").contains("#"))
    return R.listing(rows, "age", None, 5).select("session_id", "rank", "id")


@query(f"WITH {model.SQL} SELECT session_id, block_id, CAST(sum(compressed_tokens) OVER o AS BIGINT) AS tokens_so_far, count(*) OVER o AS n_so_far FROM blk WINDOW o AS (PARTITION BY session_id ORDER BY created_at, pos ROWS UNBOUNDED PRECEDING)")
def compression_stats(spark, sf_dir):
    return R.running_totals(model.blocks(spark, sf_dir))


@query("SELECT DISTINCT role, CASE WHEN role IN ('user', 'assistant') THEN role ELSE '' END AS mapped FROM conversations UNION ALL SELECT 'toolResult', 'tool'")
def search_roles(spark, sf_dir):
    rows = model.read(spark, sf_dir, "conversations").select("role").distinct().unionByName(spark.createDataFrame([("toolResult",)], "role string"))
    return rows.select("role", F.coalesce(R.search_role(F.col("role")), F.lit("")).alias("mapped"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type IN ('view', 'error') THEN event_id % 2 = 0 ELSE false END AS enabled FROM events")
def archiving_switch(spark, sf_dir):
    switch = F.when(F.col("event_type") == "click", "on").when(F.col("event_type").isin("view", "error"), "auto").otherwise("off")
    inputs = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text")))
    return model.read(spark, sf_dir, "events").select("event_id", R.archiving_enabled(switch, R.has_vision(inputs)).alias("enabled"))


@query("SELECT conv_id AS session_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') || chr(10) || chr(10) || 'extra' AS prompt FROM conversations GROUP BY conv_id")
def system_prompt(spark, sf_dir):
    rows = model.read(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))
    parts = rows.groupBy(F.col("conv_id").alias("session_id")).agg(F.transform(said, lambda x: x["text"]).alias("parts"))
    return parts.select("session_id", R.extend_prompt(F.col("parts"), F.lit("extra")).alias("prompt"))


@query("WITH e AS (SELECT user_id AS session_id, event_id AS seq, 'e' || event_id AS error FROM events WHERE event_type = 'error') SELECT session_id, array_to_string((list(error ORDER BY seq))[1:3], ',') AS errors, count(*) AS n_errors FROM e GROUP BY session_id")
def error_lists(spark, sf_dir):
    rows = model.read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), "event_id").alias("error"))
    return R.error_lists(rows).select("session_id", F.array_join("errors", ",").alias("errors"), "n_errors")


@query("SELECT user_id AS run_id, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS BIGINT) AS elapsed_s FROM events GROUP BY user_id")
def elapsed(spark, sf_dir):
    rows = base(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("run_id", R.elapsed_s(F.col("a"), F.col("b")).alias("elapsed_s"))


STOPS = "SELECT user_id AS run_id, min(epoch_us(ts)) AS a, min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) AS b FROM events GROUP BY user_id"


@query(f"SELECT run_id, CASE WHEN b IS NULL OR b - a > 10000000 THEN 'hard' ELSE 'soft' END AS signal FROM ({STOPS}) s")
def escalation(spark, sf_dir):
    rows = base(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("stopped_at"), F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("settled_at"))
    return R.escalation(rows).select("run_id", "signal")


@query(f"SELECT run_id, CAST(least(coalesce(b, a + 10000000), a + 10000000) AS BIGINT) AS ended_us, b IS NULL OR b > a + 10000000 AS by_eof FROM ({STOPS}) s")
def eof_grace(spark, sf_dir):
    rows = base(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("eof_at"), F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("exit_at"))
    return R.finish(rows).select("run_id", F.unix_micros("ended_at").alias("ended_us"), "by_eof")
