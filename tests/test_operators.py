"""Operators on literal rows: projections, blocks, archives, plans, events, streams."""

import json

from pyspark.sql import functions as F

from loomlog import model
from loomlog.functions import layout as L
from loomlog.functions import text as X
from loomlog.operators import archive as A
from loomlog.operators import blocks as B
from loomlog.operators import events as E
from loomlog.operators import messages as M
from loomlog.operators import search as S
from loomlog.plans import history as H
from loomlog.plans.turn import run_turn, truncate_in_emergency
from loomlog.sources import sessions, sinks

CORE = "session_id long, id string, seq long, role string, content_type string, tool_name string, tool_call_id string, text string"


def entries(spark, *messages, custom=()):
    rows = [(1, i, "message", f"e{i}", None, json.dumps(m)) for i, m in enumerate(messages)]
    rows += [(1, 100 + i, t, f"c{i}", json.dumps(c) if c is not None else None, None) for i, (t, c) in enumerate(custom)]
    return spark.createDataFrame(rows, "session_id long, seq long, type string, id string, content string, message string")


def text(t):
    return {"type": "text", "text": t}


def call(id, name, arguments=None):
    return {"type": "toolCall", "id": id, "name": name, **({} if arguments is None else {"arguments": arguments})}


def projected(df):
    return [(r.id, r.role, r.content_type, r.tool_name, r.tool_call_id, r.text) for r in M.to_core(df).orderBy("seq", "part").collect()]


def test_projection_of_every_kind(spark):
    df = entries(
        spark,
        {"role": "user", "content": "[m00001] hi"},
        {"role": "user", "content": [text("a"), {"type": "image"}, text("b")]},
        {"role": "assistant", "content": "{not json"},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}]},
        {"role": "assistant", "content": " \n\t\u00a0"},
        {"role": "assistant", "content": [text("go"), call("c1", "bash", {"command": "ls"})]},
        {"role": "assistant", "content": [text("two"), call("c2", "read", "f.txt"), call("c3", "grep")]},
        {"role": "toolResult", "toolCallId": "c1", "toolName": "bash", "content": [text("out")]},
        {"role": "bashExecution", "command": "ls", "output": "x"},
        {"role": "pythonExecution", "output": [text("y")], "summary": "z"},
        {"role": "other"},
        custom=[("custom_message", "note"), ("custom_message", ""), ("compaction", "no"), ("custom_message", [text("[m1] t")])],
    )
    assert projected(df) == [
        ("e0", "user", "text", None, None, "hi"),
        ("e1", "user", "text", None, None, "a\nb"),
        ("e2", "assistant", "text", None, None, "{not json"),
        ("e5", "assistant", "tool-call", "bash", "c1", 'go\n{"command":"ls"}'),
        ("e6#c2", "assistant", "tool-call", "read", "c2", "f.txt"),
        ("e6#c3", "assistant", "tool-call", "grep", "c3", "two"),
        ("e7", "tool", "tool-result", "bash", "c1", "out"),
        ("e8", "user", "text", None, None, "$ ls\nx"),
        ("e9", "user", "text", None, None, "y\nz"),
        ("c0", "user", "text", None, None, "note"),
        ("c3", "user", "text", None, None, "t"),
    ]


def parts_of(spark, df):
    v = df.withColumn("v", F.try_parse_json("message")).select("session_id", "id", M.parse_content(F.col("v")).alias("parts"))
    return v


def test_rebuild_merges_split_calls_and_drops_pruned_ones(spark):
    df = entries(spark, {"role": "user", "content": "q"}, {"role": "assistant", "content": [text("t"), call("a", "x"), call("b", "y"), call("c", "z")]}, {"role": "user", "content": "r"})
    core = M.to_core(df).drop("part").where("id <> 'e1#b'").unionByName(spark.createDataFrame([(1, "acp_summary_1", 9, "user", "text", None, None, "s")], CORE))
    out = M.rebuild(core, parts_of(spark, df)).orderBy("at").collect()
    assert [r.id for r in out] == ["e0", "e1", "e2"] and [p.id for p in out[1].parts] == [None, "a", "c"]
    hidden = spark.createDataFrame([(1, "a"), (1, "e2")], "session_id long, call_id string")
    out = M.rebuild(core, parts_of(spark, df), hidden).orderBy("at").collect()
    # a hidden call comes back with a sibling that isn't
    assert [r.id for r in out] == ["e0", "e1"] and [p.id for p in out[1].parts] == [None, "a", "c"]
    none_left = core.where("id not in ('e1#a', 'e1#c')")
    assert [r.id for r in M.rebuild(none_left, parts_of(spark, df)).orderBy("at").collect()] == ["e0", "e2"]


def test_tags_bodies_and_peeling(spark):
    df = parts_of(spark, entries(spark, {"role": "user", "content": [text("a"), {"type": "image"}, text("b")]}))
    r = df.select(
        M.tag_parts(F.col("parts"), F.lit("m00001"), F.lit("a\nb  ")).alias("same"), M.tag_parts(F.col("parts"), F.lit("m00001"), F.lit("new")).alias("new")
    ).first()
    assert [p.text for p in r.same] == ["a", None, "b\n\n[m00001]"] and [(p.type, p.text) for p in r.new] == [("image", None), ("text", "new\n\n[m00001]")]
    df = parts_of(spark, entries(spark, {"role": "user", "content": [text("[m00001]"), text("[m2] x"), text("")]}))
    assert [p.text for p in df.select(M.peel_parts(F.col("parts")).alias("p")).first().p] == ["x"]
    # old tags give way, trailing line feeds too; a message without text gets a part for its tag
    tagged = lambda *parts: [p.text for p in parts_of(spark, entries(spark, {"role": "user", "content": list(parts)})).select(M.tag_parts(F.col("parts"), F.lit("m00007"), F.lit("")).alias("p")).first().p]
    assert tagged(text("[m00003]\nx\n\n"), {"type": "image"}) == ["x\n\n[m00007]", None] and tagged({"type": "image"}) == [None, "[m00007]"] and tagged(text("[m00003]")) == ["[m00007]"]


def test_references_stay_apart_beyond_five_digits(spark):
    rows = spark.range(100_002).select(F.lit(1).alias("session_id"), F.format_string("%09d", "id").alias("id"), F.col("id").alias("seq"))
    refs = M.assign_refs(rows)
    assert refs.select("ref").distinct().count() == 100_002
    assert [r.ref for r in refs.where("seq in (0, 9998, 99998, 100000)").orderBy("seq").collect()] == ["m00001", "m09999", "m99999", "m100001"]
    both = spark.createDataFrame([("[m100001] a",), ("<acp x>m123456</acp>\nb",)], "t string").select(X.strip_ref_tag("t").alias("t")).collect()
    assert [r.t for r in both] == ["a", "b"]


def messages(spark, *rows):
    return spark.createDataFrame([(1, f"i{n}", n, *r) for n, r in enumerate(rows)], CORE)


def plain(role, t):
    return (role, "text", None, None, t)


def blocks(spark, *rows):
    """Blocks of the messages ``lo`` to ``hi`` of :func:`messages`, but for those named last in a row."""
    cols = "session_id long, block_id string, pos long, tier long, topic string, summary string, lo long, hi long, compressed_tokens long, created_at long, active boolean, member_ids array<string>, inner_ids array<string>"
    ids = lambda r: [f"i{n}" for n in range(r[3], r[4] + 1) if n not in r[8:]]
    return spark.createDataFrame([(1, f"b{i + 1}", i, *r[:8], ids(r), []) for i, r in enumerate(rows)], cols)


def test_tokens_in_view_and_null_tool_names(spark):
    m = messages(spark, plain("user", "a" * 8), ("tool", "tool-result", "compress", "c", "x" * 400), plain("assistant", "漢字"), ("tool", "tool-result", None, "d", "y" * 4))
    b = blocks(spark, (1, None, "s", 0, 0, 2, 0, True), (1, None, "s", 2, 2, 2, 1, None))
    members = model.members(b)
    assert [tuple(r) for r in B.uncovered_tokens(m, members).collect()] == [(1, 3)]
    assert B.covered(m, members).count() == 2 and B.uncovered(m, members).count() == 3


def test_cold_blocks_order_and_gate(spark):
    rows = [(1, None, "s" * 40, i, i, 5, 0 if i < 3 else i, i != 2) for i in range(6)]
    b = blocks(spark, *rows)
    assert sorted(r.block_id for r in B.cold(b, 2).collect()) == ["b1", "b2", "b4"]  # equal times: the later position is newer
    assert B.gate(B.cold(b, 2), 30).count() == 3 and B.gate(B.cold(b, 2), 31).count() == 0
    usage = spark.createDataFrame([(1, 0.8)], "session_id long, usage double")
    assert B.gate(B.cold(b, 2), 31, usage).count() == 3
    archived = spark.createDataFrame([(1, "b1"), (1, "b3")], "session_id long, block_id string")
    assert {r.block_id for r in B.unsnapped(B.cold(b, 2), archived).collect()} == {"b2", "b4"}
    assert [r.block_id for r in B.snapped_view(b, archived).collect()] == ["b1"]


def test_protected_zone(spark):
    m = messages(spark, plain("user", "q"), *[plain("assistant", "w" * 400)] * 6, ("tool", "tool-result", "bash", "c", "o"), ("tool", "tool-result", "compress", "d", "o"), plain("assistant", "end"))
    got = [r.seq for r in B.protected(m, 3, 110).where("protected").orderBy("seq").collect()]
    assert got == [0, 6, 8, 9]


def test_transcripts(spark):
    on, off = "\x0e", "\x0f"
    m = messages(
        spark, plain("user", "a"), plain("user", "b"), plain("assistant", "c\n"), plain("assistant", "d"), ("assistant", "reasoning", None, None, "why"),
        ("assistant", "tool-call", "bash", "c1", "ls"), ("tool", "tool-result", "bash", "c1", "old"), ("tool", "tool-result", "bash", "c1", f"n{on}ew"),
        ("tool", "tool-result", "bash", "late", "early"), ("assistant", "tool-call", None, "late", "x"), ("assistant", "tool-call", "t", "none", "y"), plain("assistant", " \n"),
    )
    out = lambda t: f"<out>\n{on}{t}{off}\n</out>"
    want = f"¶user:a\nb\n\n¶ai:c\nd\n\n¶think:why\n\n¶call:bash(ls)\n{out('new')}\n{out('early')}\ntool(x)\n{out('early')}\nt(y)"
    assert A.serialize(m).first().transcript == want


def test_frames_cap_and_garbage(spark):
    frames = spark.createDataFrame([("s1", 1, 10), ("s2", 2, 10), ("s3", 3, 10)], "sha string, bytes long, tokens long")
    batches = spark.createDataFrame([(1, 0, ["b1"], ["s1", "s2"]), (1, 1, ["b2", "b3"], ["s2", "gone", "s3"])], "session_id long, batch long, block_ids array<string>, shas array<string>")
    listed = A.frames_of_batches(batches, frames)
    assert [r.sha for r in listed.orderBy("batch", "pos").collect()] == ["s1", "s2", "s2", "s3"]
    kept = A.cap_frames(listed, 2)
    assert [(r.batch, r.shas) for r in A.cap_batches(batches, kept).orderBy("batch").collect()] == [(0, ["s2"]), (1, ["s2", "s3"])]
    assert A.cap_batches(batches, A.cap_frames(listed, 1)).count() == 1 and A.attachment(kept).first().shas == ["s2", "s3"]
    b = blocks(spark, *[(1, None, "s", i, i, 1, i, i == 2) for i in range(3)])
    live = A.collect_garbage(batches, b)
    assert [r.batch for r in live.collect()] == [1] and A.collect_garbage(live, b).count() == 1
    dead = b.withColumn("active", F.lit(False))
    assert A.collect_garbage(batches, dead).count() == 0 and A.attachment(A.cap_frames(A.frames_of_batches(A.collect_garbage(batches, dead), frames))).count() == 0
    there = spark.createDataFrame([("x/s3.png",)], "path string")
    assert [(r.n_frames, r.shas) for r in A.attachment(kept, there).collect()] == [(2, ["s3"])]
    assert A.attachment(kept, there.limit(0)).count() == 0
    archived = spark.createDataFrame([(1, "b1"), (1, "b2")], "session_id long, block_id string")
    assert [r.block_id for r in A.lost_blocks(archived, live).collect()] == ["b1"]


def test_pages_of_archives(spark):
    """Folding, wide cells, columns and dim words, page by page."""
    grid = L.Grid(4, 2)
    texts = spark.createDataFrame([(1, "a漢b漢c\n“d”ef"), (2, "abcdefghij"), (3, " \n"), (4, "ab\n\ncd")], "session_id long, archive string")
    got = {}
    for r in A.to_frames(texts, grid, 7).orderBy("page").collect():
        got.setdefault(r.session_id, []).append(r.body)
    # a wide character doesn't straddle the end of a line: of the first page's cells one stays free
    assert got == {1: ["a漢b漢c█", '"d"ef'], 2: ["abcdefgh", "ij"], 4: ["ab█cd"]}
    assert L.page_text("a漢b", L.Grid(2, 1, wide=False, font="silver")) == ["a漢", "b"]
    columns = L.Grid(5, 1, columns=2, dim=True)
    assert L.page_text("see the cat and dog", columns) == [f"see\n{X.DIM_ON}the{X.DIM_OFF}", f"cat\n{X.DIM_ON}and{X.DIM_OFF}", "dog"]
    assert L.page_text(f"one {X.DIM_ON}two three{X.DIM_OFF} the", columns) == [f"one\n{X.DIM_ON}two", f"{X.DIM_ON}three{X.DIM_OFF}\n{X.DIM_ON}the{X.DIM_OFF}"]
    assert L.grid_of("doc-8on16-sent-dim") == L.Grid(96, 98, 2, True, True, "8x13") and L.grid_of("silver16-bw").capacity == 9604 and L.grid_of("8on22-bw", 2048).capacity == 23808


def test_shapes_by_text():
    narrow = lambda font: (lambda c: font == "silver" and L.is_wide(c))
    # unsafe in the ideal font: silver, if that can draw it
    assert L.choose_shape("漢" + "a" * 15, "8on22-bw", drawable=narrow) == "silver16-bw" and L.choose_shape("漢" + "a" * 15, "8on22-bw") == "8on22-bw"
    assert L.choose_shape("Ж" * 5 + "a" * 15, "8on22-bw", drawable=narrow) == "8on22-bw"
    # safe, but mostly wide
    assert L.choose_shape("漢" * 8 + "a" * 24, "8on22-bw") == "silver16-bw" and L.choose_shape("漢" * 7, "8on22-bw") == "8on22-bw"
    assert L.choose_shape("漢" * 8 + "a" * 25, "8on22-bw") == "8on22-bw" and L.choose_shape("漢" * 9, "8on22-bw", fixed=True) == "8on22-bw"


def test_split_outputs_and_restored_files(spark, tmp_path):
    rows = [("r1", i, "tool-update" if i % 2 else "reply-delta", f"{i}") for i in range(40)] + [("r2", 0, "reply-complete", "x")]
    ev = spark.createDataFrame(rows, "run_id string, event_id long, kind string, text string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    for name in ("tool_name", "max_attempts", "attempt", "delay_ms"):
        ev = ev.withColumn(name, F.lit(""))
    ev = ev.withColumns({"is_error": F.lit(False), "success": F.lit(False)}).repartition(5)
    sinks.split_outputs(ev, str(tmp_path / "replies"), str(tmp_path / "activity"))
    files = [f for f in (tmp_path / "activity").glob("*.json") if f.stat().st_size]
    lines = [json.loads(x)["line"] for x in files[0].read_text().splitlines()]
    assert len(files) == 1 and lines == [f"{i}" for i in range(1, 40, 2)]
    assert spark.read.json(str(tmp_path / "replies")).count() == 21
    sinks.restore_to_files(spark.createDataFrame([("b1", "a\nb"), ("b2", "c")], "ref string, text string"), str(tmp_path / "out"))
    assert {r.ref: r.text for r in spark.read.json(str(tmp_path / "out")).collect()} == {"b1": "a\nb", "b2": "c"}


def test_shared_folders_are_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from loomlog import session

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(unset)


def test_store_and_states(spark, tmp_path):
    one = spark.createDataFrame([("s1", 1, 1, "x"), ("s1", 1, 1, "x")], "sha string, bytes long, tokens long, body string")
    path = str(tmp_path / "frames")
    sinks.store_frames(one, path)
    sinks.store_frames(one.union(spark.createDataFrame([("s2", 1, 1, "y")], one.schema)), path)
    assert sorted(r.sha for r in spark.read.parquet(path).collect()) == ["s1", "s2"]
    state = spark.range(3)
    assert sinks.save_if_changed(state, None, str(tmp_path / "state")) and not sinks.save_if_changed(state, spark.read.parquet(str(tmp_path / "state")), str(tmp_path / "state"))
    docs = spark.createDataFrame([("a", "{}"), ("b", "broken"), ("c", '{"nextBlockId": 7, "blocks": [{"blockId": "b1"}], "messageRefs": {"byRaw": {"x": "m1"}}}')], "k string, value string")
    s = {r.k: r for r in sessions.load_state(docs).collect()}
    assert s["a"].blocks == s["b"].blocks == [] and s["a"].next_block_id == 1 and s["c"].next_block_id == 7 and s["c"].by_raw == {"x": "m1"} and s["c"].blocks[0].active is None
    m = '{"frames": [{"sha": "s", "bytes": 1, "tokens": 2}, {"sha": "t"}], "archivedIds": ["b1", null], "batches": [{"blockIds": ["b1"], "shas": [], "tokens": 0, "archivedAt": 5}, {"shas": []}]}'
    r = sessions.load_manifest(spark.createDataFrame([(m,), ("",)], "value string")).collect()
    assert [f.sha for f in r[0].frames] == ["s"] and r[0].archived_ids == ["b1"] and len(r[0].batches) == 1 and r[1].frames == []


def test_session_logs_and_configuration(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"type":"message","id":"e1","message":{"role":"user","content":"hi"}}\nbroken\n{"type":"message","id":"e2","message":{"role":"assistant","content":[{"type":"text","text":"yo"}]}}\n')
    log = sessions.read_session_logs(spark, str(tmp_path))
    assert [(r.seq, r.id) for r in log.orderBy("seq").collect()] == [(0, "e1"), (1, None), (2, "e2")]
    assert [r.text for r in M.to_core(log).orderBy("seq").collect()] == ["hi", "yo"]
    layers = spark.createDataFrame([(0, "snap", "on"), (1, "snap", "off"), (1, "mystery", "x")], "layer long, key string, value string")
    assert [(r.key, r.value) for r in sessions.overlay_config(layers).collect()] == [("snap", "off")]
    l = spark.createDataFrame([(5, 6, 7), (0, 6, 7), (None, -1, 7), (None, None, 0)], "e long, a long, w long")
    assert [r[0] for r in l.select(sessions.resolve_limit(F.col("e"), F.col("a"), F.col("w"))).collect()] == [5, 6, 7, 150_000]


def test_live_tail_alignment(spark):
    p = spark.createDataFrame([(1, 0, "p0", "user", "a"), (1, 1, "p1", "assistant", "b"), (1, 2, "p2", "user", "c")], "session_id long, seq long, id string, role string, content string")
    live = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "x"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "z")], "session_id long, seq long, role string, content string")
    got = [(r.session_id, r.id) for r in sessions.merge_live(p, live).orderBy("session_id", "seq").collect()]
    assert got == [(1, "p0"), (1, "live-1"), (1, "p1"), (1, "p2"), (2, "live-0")]


def test_compress_promote_restore(spark):
    m = messages(spark, *[plain("user" if i % 2 == 0 else "assistant", "t" * 100) for i in range(8)])
    b = blocks(spark, (1, None, "s", 0, 1, 50, 0, True), (2, None, "s", 2, 3, 50, 1, True))
    members = model.members(b)
    ranges = spark.createDataFrame([(1, 0, 5, True, "t", "new"), (1, 6, 7, False, "t", "short"), (1, 90, 99, False, "t", "none")], "session_id long, lo long, hi long, by_blocks boolean, topic string, summary string")
    made = H.compress_ranges(ranges, m.withColumn("protected", F.col("seq") == 4), b, members, 300)
    out = {r.lo: r for r in made.collect()}
    assert (out[0].n_messages, out[0].n_protected, out[0].consumed, out[0].tier, out[0].error, out[0].before, out[0].after) == (5, 1, ["b1", "b2"], 3, None, 100, 75)
    assert out[6].error == "range too short" and out[6].after == 100 and out[90].error == "empty range"
    new = {r.block_id: r for r in H.apply_compression(b, made).collect()}
    assert not new["b1"].active and not new["b2"].active and new["b3"].active and new["b3"].tier == 3 and len(new) == 3
    after = H.apply_compression(b, made)
    # the protected message was in a block before, which went over to the new one
    assert new["b3"].member_ids == ["i0", "i1", "i2", "i3", "i5"] and new["b3"].inner_ids == ["b1", "b2"]
    assert sorted(r.id for r in B.uncovered(m, model.members(after)).collect()) == ["i4", "i6", "i7"]
    wanted = spark.createDataFrame([(1, "b2", None, None), (1, "b3", True, None), (1, "b1", True, "/tmp/x")], "session_id long, block_id string, inline boolean, to_file string")
    restored = {r.block_id: r for r in H.restore_blocks(wanted, after, m).collect()}
    assert restored["b2"].n == 2 and restored["b2"].text.startswith("user: ttt")
    assert {k: r.mode for k, r in restored.items()} == {"b2": "file", "b3": "inline", "b1": "file"}
    assert restored["b3"].n == 3 and restored["b3"].text.startswith("[block b1 t1] s\n\n[block b2 t2] s\n\nassistant: ttt")
    full = {r.block_id: r for r in H.restore_blocks(wanted, after, m, full=True).collect()}
    assert full["b3"].n == 5 and "block" not in full["b3"].text
    refs = M.assign_refs(m.withColumn("text", F.when(F.col("seq") == 7, F.repeat(F.lit("t"), 2000)).otherwise(F.col("text"))))
    asked = spark.createDataFrame([(1, "m00001", None, None), (1, "m00002", False, None), (1, "m00003", True, "f"), (1, "m00008", True, None)], "session_id long, ref string, inline boolean, to_file string")
    assert {r.ref: r.mode for r in H.restore_messages(asked, refs).collect()} == {"m00001": "inline", "m00002": "file", "m00003": "file", "m00008": "file"}
    inner = spark.createDataFrame([(1, "b3", "b2"), (1, "b2", "b1")], "session_id long, block_id string, inner_id string")
    assert {r.block_id for r in H.nested_blocks(spark.createDataFrame([(1, "b3")], "session_id long, block_id string"), inner).collect()} == {"b1", "b2", "b3"}
    chain = spark.createDataFrame([(1, f"b{i}", f"b{i - 1}") for i in range(2, 8)] + [(1, "b1", "b7")], inner.schema)  # deeper than there are tiers, and round
    assert {r.block_id for r in H.nested_blocks(spark.createDataFrame([(1, "b6")], "session_id long, block_id string"), chain).collect()} == {f"b{i}" for i in range(1, 8)}


def test_protected_messages_stay_in_view(spark):
    m = messages(spark, *[plain("user", "t" * 100)] * 30)
    none = blocks(spark, (1, None, "s", 0, 0, 0, 0, False)).limit(0)
    rows = m.withColumn("protected", F.col("seq").isin(3, 27, 28, 29))
    ranges = spark.createDataFrame([(1, 0, 29, False, "t", "s")], "session_id long, lo long, hi long, by_blocks boolean, topic string, summary string")
    made = H.compress_ranges(ranges, rows, none, model.members(none), 0)
    assert made.first().n_protected == 4
    assert sorted(r.seq for r in B.uncovered(m, model.members(H.apply_compression(none, made))).collect()) == [3, 27, 28, 29]


def test_turn_and_emergency(spark):
    m = messages(spark, *[plain("user", "t" * 100)] * 4, ("tool", "tool-result", "read", "c", "o" * 3000))
    b = blocks(spark, (1, None, "s", 0, 0, 25, 0, True))
    t = run_turn(m, b, model.members(b), 1000, 1, 10)
    n = t["nudges"].first()
    assert n.emergency and n.should_nudge and n.n_visible == 4 and (n.top_lo, n.top_hi) == (4, 4)
    cut = t["visible"].where("role = 'tool'").first()
    assert "elided" in cut.text and len(cut.text) < 2100 and cut.tagged == f"{cut.text}\n\n[m00005]"
    assert truncate_in_emergency(m, t["nudges"].withColumn("emergency", F.lit(False))).where("text like '%elided%'").count() == 0
    # an emergency nudges again and again, others once for each last user message
    assert n.inject and n.turn_key == "i3" and t["shown"].count() == 0
    calm = run_turn(m, b, model.members(b), 1500, 1, 10)
    assert not calm["nudges"].first().emergency and calm["nudges"].first().inject and [tuple(r) for r in calm["shown"].collect()] == [(1, "i3")]
    again = run_turn(m, b, model.members(b), 1500, 1, 10, shown=calm["shown"])
    assert again["nudges"].first().should_nudge and not again["nudges"].first().inject and again["shown"].count() == 1
    hidden = spark.createDataFrame([(1, "c"), (1, "i2")], "session_id long, call_id string")
    assert sorted(r.seq for r in run_turn(m, b, model.members(b), 1500, 1, 10, hidden_calls=hidden)["visible"].collect()) == [1, 3]


def test_search_ranks(spark):
    m = messages(spark, plain("user", "apple apple pear"), plain("assistant", "pear"), plain("user", "x"), plain("user", "apple in view"))
    b = blocks(spark, (1, "fruit", "apple", 0, 2, 5, 0, False))
    docs = S.search_docs(m, b, model.members(b))
    assert {(r.kind, r.ref) for r in docs.collect()} == {("block", "b1"), ("message", "m00001"), ("message", "m00002")}
    top = S.top_k(S.bm25(docs, ["apple"]), 1).collect()
    assert len(top) == 1 and top[0].ref == "m00001" and top[0].score == round(top[0].score, 6)


LINES = [
    ('{"type":"tool_execution_start","toolName":"bash","args":{"command":"ls -l"}}', "tool-start", "[tool] bash ls -l"),
    ('{"type":"tool_execution_start","toolName":"read","args":{"path":"f"}}', "tool-start", '[tool] read {"path":"f"}'),
    ('{"type":"tool_execution_update","toolCallId":"t","partialResult":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b\\n"}]}}', "tool-update", "ab"),
    ('{"type":"tool_execution_update","toolCallId":"t","partialResult":{"content":[{"type":"text","text":"a\\n\\n"}]}}', "tool-update", "a\n"),
    ('{"type":"tool_execution_end","toolName":"bash","isError":true}', "tool-end", "[done] bash (error)"),
    ('{"type":"auto_retry_start","attempt":1,"maxAttempts":3,"delayMs":50,"errorMessage":"slow"}', "retry-start", "[retry] attempt 1/3, backoff 50ms — slow"),
    ('{"type":"auto_retry_end","success":false,"attempt":2}', "retry-end", "[retry] attempt 2 failed"),
    ('{"type":"message_update","assistantMessageEvent":{"type":"text_delta","delta":"x"}}', "reply-delta", None),
    ('{"type":"message_update","assistantMessageEvent":{"type":"other"}}', None, None),
    ('{"type":"mystery"}', None, None),
    ("broken", None, None),
    ("3", None, None),
]


def test_event_lines(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, line string")
    parsed = E.parse_events(df)
    got = {r.i: (r.kind, r.a) for r in parsed.select("i", "kind", E.activity(parsed).alias("a")).collect()}
    assert got == {i: (k, a) for i, (_, k, a) in enumerate(LINES) if k}


def stream_of(spark, *rows):
    data = [("r", f"2020-01-01 00:00:{s:02d}", i, k, t, c) for i, (s, k, t, c) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, ts string, event_id long, kind string, text string, call_id string").withColumn("ts", F.to_timestamp("ts"))


def test_deltas_segments_replies(spark):
    ev = stream_of(
        spark, (0, "tool-update", "ab", "t"), (1, "tool-update", "abc", "t"), (2, "tool-update", "x", "t"), (3, "thinking-delta", " a", ""), (4, "thinking-delta", "b ", ""),
        (5, "reply-delta", "old", ""), (6, "thinking-delta", " \n", ""), (7, "reply-complete", "R", ""), (8, "reply-delta", "s", ""), (9, "thinking-delta", "z", ""),
    )
    assert [r.delta for r in E.tool_deltas(ev).orderBy("event_id").collect()] == ["ab", "c", "x"]
    assert [r.thinking for r in E.thinking_segments(ev).orderBy("segment").collect()] == ["ab", "z"]
    assert E.replies(ev).first().reply == "Rs"
    assert [r.event_id for r in E.idle_gaps(stream_of(spark, (0, "a", "", ""), (5, "a", "", ""), (11, "a", "", "")), 5).collect()] == [2]
    late = E.hard_limit(stream_of(spark, (0, "a", "", ""), (5, "a", "", ""), (11, "a", "", "")), 4).first()
    assert (late.n_late, late.first_late) == (2, 1)


def test_status_and_delivery(spark):
    df = spark.createDataFrame([(0, True), (1, True), (None, True), (None, False)], "code int, out boolean")
    assert [r[0] for r in df.select(E.run_status(F.col("code"), F.col("out"))).collect()] == ["completed", "failed", "completed", "failed"]
    d = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "w boolean, c boolean, i boolean")
    assert [r[0] for r in d.select(E.delivery(F.col("w"), F.col("c"), F.col("i"))).collect()] == ["wait", "consumed", "inject", "held"]
    w = spark.createDataFrame([(None,), (0.1,), (20.0,), (999.0,)], "s double")
    assert [r[0] for r in w.select(E.wait_clamp(F.col("s"))).collect()] == [10.0, 1.0, 20.0, 300.0]


def test_idle_watch_over_several_batches(spark, tmp_path):
    from loomlog.streaming import runs as R

    source, schema = tmp_path / "in", "run_id string, ts timestamp, event_id long"
    source.mkdir()
    query = None
    batches = [[("r", 0, 1), ("r", 4, 2)], [("r", 20, 3), ("q", 21, 4)], [("q", 60, 5)], [("q", 61, 6)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(r, s, e) for r, s, e in rows], "run_id string, s long, event_id long").select("run_id", F.timestamp_seconds("s").alias("ts"), "event_id")
        df.coalesce(1).write.parquet(str(source / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source)).withWatermark("ts", "1 second")
        out = R.watch_idle(stream.withColumn("run_id", F.when(F.col("run_id") == "r", 1).otherwise(2).cast("long")), 10, 15)
        query = R.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r.run_id, r.cause, r.event_id or 0) for r in query.collect())
    assert (1, "gap", 3) in got and (1, "hard", 3) in got and (1, "idle", 0) in got and any(r[:2] == (2, "idle") or r[:2] == (2, "gap") for r in got)


def test_status_rules(spark):
    from loomlog.operators import status as R

    df = spark.createDataFrame([("on", ["text"], ["a", "b"]), ("off", ["image"], []), ("auto", ["image"], None), (None, None, ["x"])], "s string, i array<string>, p array<string>")
    got = df.select(R.archiving_enabled(F.col("s"), R.has_vision(F.col("i"))).alias("e"), R.extend_prompt(F.col("p"), F.lit("z")).alias("p"), R.append_archived(F.col("p"), F.array(F.lit("a"))).alias("a")).collect()
    assert [tuple(r) for r in got] == [(True, "a\nb\n\nz", ["a", "b", "a"]), (False, "\n\nz", ["a"]), (True, "\n\nz", ["a"]), (False, "x\n\nz", ["x", "a"])]
    t = lambda s: None if s is None else f"2020-01-01 00:00:{s:02d}"
    stops = spark.createDataFrame([("a", t(0), t(5)), ("b", t(0), t(11)), ("c", t(0), None)], "run_id string, x string, y string").select("run_id", F.to_timestamp("x").alias("stopped_at"), F.to_timestamp("y").alias("settled_at"))
    assert [r.signal for r in R.escalation(stops).orderBy("run_id").collect()] == ["soft", "hard", "hard"]
    ends = stops.select("run_id", F.col("stopped_at").alias("eof_at"), F.col("settled_at").alias("exit_at"))
    assert [(r.by_eof, r.ended_at.second) for r in R.finish(ends).orderBy("run_id").collect()] == [(False, 5), (True, 10), (True, 10)]
    frames = spark.createDataFrame([("ab12",), ("cd34",)], "sha string")
    assert [r.sha for r in R.present_frames(frames, spark.createDataFrame([("file:/x/ab12.png",)], "path string")).collect()] == ["ab12"]
    m = messages(spark, ("tool", "tool-result", "b", "1", "x" * 40), ("tool", "tool-result", "a", "2", "y"), plain("user", "z" * 80))
    assert [r.seq for r in R.listing(m, "tool").orderBy("rank").collect()] == [1, 0, 2] and [r.seq for r in R.listing(m, "time", "b").collect()] == [0]
