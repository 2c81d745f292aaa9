"""The front end to end: fold, search, restore, archive, collect."""

import pytest
from pyspark.sql import functions as F

from loomlog import model
from loomlog.history import History


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, f"i{i}", i, "user" if i % 2 == 0 else "assistant", "text", None, None, f"message {i} about {'apples' if i < 4 else 'pears'} " + "x" * 300) for i in range(12)]
    core = spark.createDataFrame(rows, "session_id long, id string, seq long, role string, content_type string, tool_name string, tool_call_id string, text string")
    none = "session_id long, block_id string, pos long, tier long, topic string, summary string, lo long, hi long, compressed_tokens long, created_at long, active boolean, member_ids array<string>, inner_ids array<string>"
    return History(core, spark.createDataFrame([], none), limit=1000, recent=2, recent_tokens=100, hot_blocks=0, snap_threshold=1, most_frames=2)


def ranges(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "session_id long, lo long, hi long, by_blocks boolean, topic string, summary string")


def test_fold_search_restore_archive(spark, history):
    folded, report = history.compress(ranges(spark, (0, 3, False, "fruit", "apples were discussed"), (4, 7, False, None, "pears too")), 100)
    assert [r.error for r in report.collect()] == [None, None]
    before, after = history.overview().first(), folded.overview().first()
    assert after.tokens < before.tokens and after.n_active == 2 and after.tiers == "T1:2"
    assert folded.search("Apples?", 2).collect()[0].ref in ("b1", "m00001") and folded.search("zebra").count() == 0 and folded.search("").count() == 0
    assert {r.kind for r in folded.search("pears", 10, blocks_only=True).collect()} == {"block"}
    targets = spark.createDataFrame([(1, "m00002"), (1, "b1"), (1, "2"), (1, "zzz")], "session_id long, target string")
    got = {r.target: r for r in folded.restore(targets).collect()}
    assert [got[t].found for t in ("m00002", "b1", "2", "zzz")] == ["message", "block", "block", "none"] and got["zzz"].text == "b1, b2"
    assert got["b1"].mode == "file" and got["m00002"].mode == "inline"
    assert got["b1"].text.startswith("user: message 0") and folded.overview().first().n_active == 2

    archived = folded.archive()
    assert archived.batches.first().block_ids == ["b1", "b2"] and archived.candidates().count() == 0 and archived.attachment().first().n_frames == 1
    promoted, _ = archived.compress(ranges(spark, (0, 7, True, "all", "fruit")), 0)
    whole = promoted.restore(spark.createDataFrame([(1, "b3")], "session_id long, target string"), full=True).first().text
    assert whole.count("message") == 8 and promoted.restore(spark.createDataFrame([(1, "b3")], "session_id long, target string")).first().text == "[block b1 t1] apples were discussed\n\n[block b2 t1] pears too"
    assert {(r.block_id, r.tier, r.active) for r in promoted.blocks.collect()} == {("b1", 1, False), ("b2", 1, False), ("b3", 2, True)}
    assert promoted.collect_garbage().batches.count() == 0 and promoted.collect_garbage().frames.count() == 0
    again = promoted.archive(promoted.candidates())
    assert again.batches.count() == 2 and sorted(r.batch for r in again.batches.collect()) == [0, 1]


def test_a_turn_and_status(spark, history):
    t = history.turn()
    assert t["nudges"].first().emergency and t["visible"].count() == 12
    assert [r.rank for r in history.status("time", limit=3).orderBy("rank").collect()] == [1, 2, 3]
    assert history.candidates().count() == 0 and history.archived.count() == 0


def test_on_the_test_tables(spark, sf_dir):
    h = History(model.core(spark, sf_dir), model.blocks(spark, sf_dir), hot_blocks=1, snap_threshold=10)
    assert h.overview().count() == h.messages.select("session_id").distinct().count()
    a = h.archive()
    n = a.attachment().agg(F.max("n_frames")).first()[0]
    assert 0 < n <= 16
