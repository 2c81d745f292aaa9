"""Streams of delegated runs: parsing, deltas, idle watches, once-only endings and split outputs.

Parsing and rendering have no state and are the batch expressions. Deltas keep the last snapshot of
each call, idle watches the last event of each run; both are keyed state with event time, so that a
restart goes on from the checkpoint. Within a micro-batch the rows of a key are put in event order;
rows later than the watermark are the source's loss, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import activity, parse_events
from ..session import ship_package


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """NDJSON files of runs as a stream: run (the file's name), line."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[a-z]+)?$", 1)
    return rows.select(name.alias("run_id"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("line"))


def stream_events(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines (run_id, ts, event_id, line) -> parsed events with a watermark on ``ts``."""
    return parse_events(lines.withWatermark("ts", late))


def stream_activity(events: DataFrame) -> DataFrame:
    return events.select("run_id", "ts", "event_id", activity(events).alias("line")).where("line is not null")


def stream_deltas(events: DataFrame) -> DataFrame:
    """What each snapshot of a call's output adds to the one before, across micro-batches."""
    ship_package(events.sparkSession)

    def deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, text in zip(rows["event_id"], rows["text"], strict=True):
            out.append((key[0], event, text[len(before) :] if text.startswith(before) else text))
            before = text
        state.update((before,))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "delta"])

    updates = events.where("kind = 'tool-update'").select("run_id", "call_id", "ts", "event_id", "text")
    return updates.groupBy("run_id", "call_id").applyInPandasWithState(deltas, "run_id long, event_id long, delta string", "before string", "append", GroupStateTimeout.NoTimeout)


def watch_idle(events: DataFrame, idle_s: int = 300, hard_s: int = 1800) -> DataFrame:
    """Rows for what ends a run: ``gap`` (an event came after more than ``idle_s``), ``idle`` (none
    came until the watermark passed) or ``hard`` (the first event over ``hard_s`` after the start).

    Each event arms the timer again; a run whose timer has fired starts afresh with its next event.
    """
    ship_package(events.sparkSession)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            last, _, _ = state.get
            state.remove()
            out.append((key[0], None, "idle", float(idle_s), last))
        else:
            last, started, over = state.get if state.exists else (None, None, False)
            rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
            for event, us in zip(rows["event_id"].tolist(), rows["us"].tolist(), strict=True):
                started = us if started is None else started
                if last is not None and us - last > idle_s * 1_000_000:
                    out.append((key[0], event, "gap", (us - last) / 1e6, us))
                if not over and us - started > hard_s * 1_000_000:
                    over = True
                    out.append((key[0], event, "hard", (us - started) / 1e6, us))
                last = us
            state.update((last, started, over))
            state.setTimeoutTimestamp(max(last // 1000 + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "cause", "seconds", "at_us"]).astype({"event_id": "Int64"})

    rows = events.select("run_id", "ts", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("run_id").applyInPandasWithState(watch, "run_id long, event_id long, cause string, seconds double, at_us long", "last long, started long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def end_once(endings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Endings (run_id, ts, cause): the first that arrives of each run within the watermark."""
    return endings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])


def active_windows(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Spans of activity of each run that no gap interrupts."""
    rows = events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_split(events: DataFrame, reply_path: str, activity_path: str, checkpoint: str, once: bool = True):
    """Two outputs of one stream. A batch that is written again replaces itself, so that each result
    is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("kind in ('reply-delta', 'reply-complete')").select("run_id", "ts", "event_id", "kind", "text").write.mode("overwrite").parquet(f"{reply_path}/batch={number}")
        stream_activity(batch).write.mode("overwrite").parquet(f"{activity_path}/batch={number}")
        batch.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all there is, to Parquet, and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
