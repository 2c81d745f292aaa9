"""Writers: states, content-addressed frames, logs, restored texts, split run outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators.archive import new_frames


def save_state(state: DataFrame, path: str) -> None:
    """Replace a state table; Spark's commit makes it appear as a whole."""
    state.write.mode("overwrite").json(path)


def save_if_changed(new: DataFrame, old: DataFrame | None, path: str) -> bool:
    """Write only where rows differ from what is stored; says whether it wrote."""
    if old is not None and new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty():
        return False
    new.write.mode("overwrite").parquet(path)
    return True


def store_frames(frames: DataFrame, path: str) -> DataFrame:
    """Append frames whose hash isn't stored yet; returns those that were new."""
    spark = frames.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    fresh = new_frames(frames, stored)
    fresh.write.mode("append").parquet(path)
    return fresh


def append_log(lines: DataFrame, path: str, day: str = "day") -> None:
    """Append log lines (``line``, and a day to part by, in place of rotation by size)."""
    lines.select("line", day).write.mode("append").partitionBy(day).text(path)


def restore_to_files(texts: DataFrame, path: str) -> None:
    """Write restored texts (ref, text), one JSON line each, with their references; files are as many as
    there are partitions, however many texts there are."""
    texts.select("ref", "text").write.mode("overwrite").json(path)


def split_outputs(events: DataFrame, reply_path: str, activity_path: str) -> None:
    """One table of events, two outputs: replies and activity, as JSON lines with their run and their
    place in it. A run's lines are in one file, in order; many runs share a file."""
    from ..operators.events import activity

    place = ["run_id", "ts", "event_id"]
    replies = events.where("kind in ('reply-delta', 'reply-complete')").select(*place, "kind", "text")
    lines = events.select(*place, activity(events).alias("line")).where("line is not null")
    for rows, path in ((replies, reply_path), (lines, activity_path)):
        rows.repartition("run_id").sortWithinPartitions(*place).write.mode("append").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
