"""Session logs: readers, the merge of a live tail, states, manifests and configurations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ENTRY_SCHEMA
from ..session import ship_package

#: A few entries of every kind, for checks of readers: type and id.
ENTRIES = (("message", "e1"), ("custom_message", "e2"), ("message", "e3"), ("model_change", "e4"), ("compaction", "e5"), ("message", "e6"))


def read_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines session logs -> entries with their file as session and their line's order.

    Malformed lines keep their place as rows with null fields. Files may be split: the order is the
    position in the file, not a counter of rows read.
    """
    lines = spark.read.option("wholetext", "false").text(path).select("value", F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    order = Window.partitionBy("session_id").orderBy("block", "n")
    rows = lines.withColumn("seq", F.row_number().over(order) - 1).withColumn("e", F.from_json("value", ENTRY_SCHEMA))
    return rows.select("session_id", F.col("seq").cast("long").alias("seq"), "e.*")


def literal_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], "seq long, type string, id string")


def merge_live(persisted: DataFrame, live: DataFrame) -> DataFrame:
    """Align live messages with persisted ones in order: the first persisted row of the same role
    from the pointer on matches if its content is equal, and moves the pointer behind it; a live
    row without a match gets the id ``live-i`` and leaves the pointer.

    ``persisted`` (session_id, seq, id, role, content), ``live`` (session_id, seq, role, content);
    a session's rows are one task's, which the alignment needs.
    """
    ship_package(persisted.sparkSession)

    def align(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("seq"), right.sort_values("seq")
        roles, contents, ids = left["role"].tolist(), left["content"].tolist(), left["id"].tolist()
        at: dict[str, list[int]] = {}
        for i, role in enumerate(roles):
            at.setdefault(role, []).append(i)
        next_of = dict.fromkeys(at, 0)
        pointer, out = 0, []
        for i, row in enumerate(right.itertuples(index=False)):
            places = at.get(row.role, [])
            k = next_of.get(row.role, 0)
            while k < len(places) and places[k] < pointer:
                k += 1
            next_of[row.role] = k
            if k < len(places) and contents[places[k]] == row.content:
                out.append((row.session_id, row.seq, ids[places[k]], row.role, False))
                pointer = places[k] + 1
            else:
                out.append((row.session_id, row.seq, f"live-{i}", row.role, True))
        return pd.DataFrame(out, columns=["session_id", "seq", "id", "role", "live"])

    schema = f"session_id {live.schema['session_id'].dataType.simpleString()}, seq long, id string, role string, live boolean"
    return persisted.groupBy("session_id").cogroup(live.groupBy("session_id")).applyInPandas(align, schema)


BLOCK = (
    "blockId string, runId string, tier bigint, topic string, summary string, directMessageIds array<string>, effectiveMessageIds array<string>, "
    "directBlockIds array<string>, compressedTokens bigint, createdAt bigint, survivedCount bigint, generation bigint, active boolean, compressCallId string"
)
STATE = (
    f"blocks array<struct<{', '.join(f.replace(' ', ': ', 1) for f in BLOCK.split(', '))}>>, nextBlockId bigint, nextRunId bigint, "
    "messageRefs struct<byRaw: map<string,string>, byRef: map<string,string>, nextRef: bigint>, stats struct<tokensCompressed: bigint, compressionCount: bigint>"
)
MANIFEST = (
    "frames array<struct<sha: string, bytes: bigint, tokens: bigint>>, archivedIds array<string>, "
    "batches array<struct<blockIds: array<string>, shas: array<string>, tokens: bigint, archivedAt: bigint>>"
)


def load_state(documents: DataFrame, column: str = "value") -> DataFrame:
    """State documents (JSON text) -> their fields; what is missing or malformed gets its default."""
    s = F.from_json(F.col(column), STATE)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return documents.select(
        *(c for c in documents.columns if c != column),
        F.coalesce(s["blocks"], F.from_json(F.lit('{"blocks":[]}'), STATE)["blocks"]).alias("blocks"),
        F.coalesce(s["nextBlockId"], F.lit(1)).alias("next_block_id"),
        F.coalesce(s["nextRunId"], F.lit(1)).alias("next_run_id"),
        F.coalesce(s["messageRefs"]["byRaw"], none).alias("by_raw"),
        F.coalesce(s["messageRefs"]["byRef"], none).alias("by_ref"),
        F.coalesce(s["messageRefs"]["nextRef"], F.lit(1)).alias("next_ref"),
        F.coalesce(s["stats"]["tokensCompressed"], F.lit(0)).alias("tokens_compressed"),
        F.coalesce(s["stats"]["compressionCount"], F.lit(0)).alias("compression_count"),
    )


def load_manifest(documents: DataFrame, column: str = "value") -> DataFrame:
    """Manifests (JSON text) -> frames, archived_ids, batches; malformed elements drop out one by one."""
    m = F.from_json(F.col(column), MANIFEST)
    blank = F.from_json(F.lit('{"frames":[],"archivedIds":[],"batches":[]}'), MANIFEST)
    ok_frame = lambda f: f["sha"].isNotNull() & f["bytes"].isNotNull() & f["tokens"].isNotNull()
    ok_batch = lambda b: b["blockIds"].isNotNull() & b["shas"].isNotNull() & b["tokens"].isNotNull() & b["archivedAt"].isNotNull()
    return documents.select(
        *(c for c in documents.columns if c != column),
        F.filter(F.coalesce(m["frames"], blank["frames"]), ok_frame).alias("frames"),
        F.filter(F.coalesce(m["archivedIds"], blank["archivedIds"]), lambda x: x.isNotNull()).alias("archived_ids"),
        F.filter(F.coalesce(m["batches"], blank["batches"]), ok_batch).alias("batches"),
    )


#: Settings that are read; others are dropped.
KNOWN_SETTINGS = ("contextLimit", "preserveRecentMessages", "bashTimeout", "maxOutputBytes", "hotBlocks", "snapThreshold", "idleTimeout", "snap", "showThinking")


def overlay_config(layers: DataFrame) -> DataFrame:
    """(layer, key, value) -> the value of each known key in the last layer that sets it."""
    known = layers.where(F.col("key").isin(*KNOWN_SETTINGS) & F.col("value").isNotNull())
    return known.groupBy("key").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def resolve_limit(environment: Column, adapter: Column, window: Column, default: int = 150_000) -> Column:
    """The first positive one of environment, adapter and live window, else the default."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(environment), positive(adapter), positive(window), F.lit(default)).cast("long")


def live_limit(usage_window: Column, model_window: Column) -> Column:
    return F.coalesce(F.when(usage_window > 0, usage_window), F.when(model_window > 0, model_window), F.lit(0)).cast("long")
