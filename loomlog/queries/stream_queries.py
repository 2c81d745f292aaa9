"""The event operators as streams over the event table; results equal their batch twins'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import read
from ..registry import SQL, query
from ..session import shared_path
from ..streaming import runs as R
from .event_queries import lines_of


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return lines_of(rows.select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k")))


def _all(spark, stream, label):
    return R.run_to_end(stream, shared_path(spark, label), shared_path(spark, f"{label}-checkpoint"))


@query(SQL["activity_lines"])
def stream_activity(spark, sf_dir):
    return _all(spark, R.stream_activity(R.stream_events(_stream(spark, sf_dir))), "activity").select("run_id", "event_id", "line")


@query(SQL["tool_output_delta"])
def stream_tool_delta(spark, sf_dir):
    return _all(spark, R.stream_deltas(R.stream_events(_stream(spark, sf_dir))), "deltas")


@query(SQL["idle_gaps"])
def stream_idle_gaps(spark, sf_dir):
    rows = _stream(spark, sf_dir).withWatermark("ts", "1 hour")
    out = _all(spark, R.watch_idle(rows, 43_200, 1 << 40), "idle")
    return out.where("cause = 'gap'").select("run_id", "event_id", F.col("seconds").alias("gap_s"))


@query("SELECT run_id, count(*) AS n_windows, CAST(max(n) AS BIGINT) AS longest FROM (SELECT run_id, g, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id AS run_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS s FROM events) a) b GROUP BY run_id, g) c GROUP BY run_id")
def active_windows(spark, sf_dir):
    """Spans of activity without a gap of an hour."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id")
    windows = R.active_windows(rows, "1 hour")
    return windows.groupBy("run_id").agg(F.count("*").alias("n_windows"), F.max("n").alias("longest"))
