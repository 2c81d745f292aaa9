"""Scalar functions against plain Python."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.functions import guardrails as G
from loomlog.functions import layout as L
from loomlog.functions import text as X


def values(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.i)]


def test_token_estimates(spark):
    got = values(spark, ["", None, "漢字仮名交文章字", "漢字 ascii text", "ab😀", "a" * 23], X.token_estimate("t"), X.quarter_tokens("t"))
    assert [g[0] for g in got] == [0, 0, 8, 2 + 3, 1, 6] and [g[1] for g in got] == [0, 0, 2, 4, 1, 6]


def cap_plain(text, most):
    data = text.encode()
    if len(data) <= most:
        return text
    head = data[:most].decode("utf-8", "ignore")
    line = head.rfind("\n")
    return head[:line] if line >= most // 2 else head


@pytest.mark.parametrize("most", [4, 5, 6, 7, 10, 11])
def test_byte_cap_never_splits_a_character(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("aé漢😀\n") for _ in range(rng.randrange(12))) for _ in range(150)] + ["abc\ndefg", "ab\ncdefgh", "\n\n\n\n\n\n\n\n"]
    assert [g[0] for g in values(spark, texts, X.byte_cap("t", most))] == [cap_plain(t, most) for t in texts]


def test_truncation(spark):
    long = "h" * 1500 + "t" * 1500
    got = values(spark, ["short", long], X.truncate_head_tail("t"), X.truncate_ellipsis("t", 4), X.head_preview("t", 5), X.one_line("t", 10))
    assert got[0] == ("short", "sho…", "short", "short")
    assert got[1][0] == "h" * 1200 + " […1000ch elided…] " + "t" * 800 and got[1][2] == "hhhhh\n[+2995 more characters]"


def test_blanks_ansi_and_tags(spark):
    texts = ["a \xa0 b", "a \n b", "a﻿b", "  x\n", "a\xad b", "a b", "\x1b[31mred\x1b[0m\x1b]0;t\x07!", "[m00012] hi", "<acp x=1>m00001</acp>\nhi", "x [m1] y"]
    got = values(spark, texts, X.collapse_blanks("t"), X.strip_ansi("t"), X.strip_ref_tag("t"))
    assert [g[0] for g in got[:6]] == ["a b", "a█b", "ab", "x", "a b", "a█b"]
    assert got[6][1] == "red!" and got[7][2] == "hi" and got[8][2] == "hi" and got[9][2] == "x [m1] y"


def test_dim_stopwords(spark):
    on, off = X.DIM_ON, X.DIM_OFF
    got = values(spark, ["The cat and éand", f"{on}the{off} the", "theme"], X.dim_stopwords("t"))
    assert [g[0] for g in got] == [f"{on}The{off} cat {on}and{off} éand", f"{on}the{off} {on}the{off}", "theme"]


def test_ids_versions_and_logs(spark):
    assert [g[0] for g in values(spark, ["b3", "3", "", " ", "xyz", "b", "abc123", "b-"], X.parse_block_id("t"))] == ["b3", "b3", None, None, None, None, None, None]
    pairs = spark.createDataFrame([("1.2.3", "1.2.2"), ("v2.0", "1.9.9"), ("1.0.0", "1.0.0"), ("1.x.9", "1.0.1"), ("", "0.0.1")], "a string, b string")
    assert [r.n for r in pairs.select(X.semver_newer("a", "b").alias("n")).collect()] == [True, True, False, True, False]
    f = X.log_fields("t")
    assert values(spark, ["2020-01-01T00:00:00Z [warn] [scope x] a=1 bc=two"], f["level"], f["scope"], f["fields"]["bc"])[0] == ("warn", "scope x", "two")
    assert values(spark, ["x"], X.usage_bar(F.lit(250.0)), X.usage_bar(F.lit(-3.0)), X.usage_bar(F.lit(50.0)))[0] == ("█" * 20, "░" * 20, "█" * 10 + "░" * 10)


CONTENT = "array<struct<type: string, text: string>>"


def test_guardrails(spark):
    rows = [(1, [("text", "a" * 30), ("image", None), ("text", "b")]), (2, [("image", None)]), (3, [("text", "x"), ("text", "Command timed out after 90 seconds")]), (4, [])]
    df = spark.createDataFrame(rows, f"i int, c {CONTENT}")
    out = {r.i: r for r in df.select("i", G.cap_output("c", 10).alias("capped"), G.detect_timeout("c").alias("s"), G.append_notice("c", F.lit("!")).alias("n"), G.cap_output("c", 0).alias("same")).collect()}
    assert [p.type for p in out[1].capped] == ["image", "text"] and out[1].capped[1].text == "a" * 10 + "\n\n[output capped: 22 bytes dropped]"
    assert [p.type for p in out[2].capped] == ["image"] and out[3].s == 90 and out[1].s is None
    assert out[1].n[2].text == "b!" and [p.type for p in out[2].n] == ["image", "text"] and out[4].n[0].text == "!" and len(out[1].same) == 3
    assert values(spark, ["x"], G.suggest_timeout(F.lit(10)), G.suggest_timeout(F.lit(61)), G.suggest_timeout(F.lit(9999)))[0] == (120, 122, 3600)
    t = values(spark, ["x"], G.default_timeout(F.lit(None).cast("long")), G.default_timeout(F.lit(5)), G.default_timeout(F.lit(None).cast("long"), 0))[0]
    assert t == (60, None, None)


def test_geometry_and_prices(spark):
    g = L.geometry(*(F.col(c) for c in ("cell_width", "cell_height", "line_repeat", "columns", "frame_size")))
    rows = {r.shape: (r.c, r.r, r.cap) for r in L.shapes(spark).select("shape", g["cols"].alias("c"), g["rows"].alias("r"), g["capacity"].alias("cap")).collect()}
    want = {"8on22-bw": (196, 71, 13916), "11on16-bw": (142, 98, 13916), "silver16-bw": (98, 98, 9604), "8x8r-bw": (196, 98, 19208), "6x6u-bw": (261, 261, 68121), "6x12-dim": (261, 130, 33930), "8x13-bw": (196, 120, 23520), "5x8-bw": (515, 322, 165830), "doc-8on16-bw": (96, 98, 18816)}
    assert {k: rows[k] for k in want} == want and len(rows) == 17
    prices = [r[0] for r in spark.createDataFrame([("google", 1568), ("openai", 1568), ("x", 1568), ("openai", 2048), ("x", 1932), ("openai", 2576)], "f string, s long").select(L.frame_price(F.col("f"), F.col("s"))).collect()]
    assert prices == [1120, 2882, 3293, 4916, 5000, 7874]


def test_resolve_shape(spark):
    models = [("anthropic-messages", "claude-opus-4-8"), ("x", "Kimi"), ("google-vertex", "gemini"), ("bedrock-converse-stream", None)]
    rows = {r.id: r for r in L.resolve_shape(spark.createDataFrame(models, "api string, id string")).collect()}
    assert (rows["claude-opus-4-8"].shape, rows["claude-opus-4-8"].frame_size, rows["claude-opus-4-8"].frame_tokens) == ("11on16-bw", 1932, 5000)
    assert rows["gemini"].frame_size == 2048 and rows["gemini"].frame_tokens == 1120 and rows["Kimi"].shape == "8on22-bw" and rows[None].shape == "11on16-bw"


def test_folding():
    assert L.fold("“x” … → ✅ ─│┌ \U0001f680")[0] == '"x" ... -> [OK] -|+ [RUN]'
    assert L.fold("ﬁne ① Ａ漢") == ("fine 1 Ａ漢", 8, 0)
    text, graphic, lost = L.fold("aЖb́", drawable=lambda c: False)
    assert (text, graphic, lost) == ("a?b", 4, 1)
    assert L.fold("\x1b[1mx\x1b[0m\x00y")[0] == "xy"
    assert L.choose_shape("漢" * 10, "8on22-bw") == "silver16-bw" and L.choose_shape("abc", "8on22-bw") == "8on22-bw" and L.choose_shape("Ж" * 10, "8on22-bw") == "8on22-bw"


@given(st.text(alphabet="ab 漢\n" + X.DIM_ON + X.DIM_OFF, max_size=60), st.integers(2, 7), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_pages_hold_all_characters_within_capacity(text, cols, rows):
    pages = L.paginate(text, cols * rows, cols)
    if any(L.cells(c) for c in text):
        assert "".join(pages) == text
    for page in pages:
        assert L.shown_chars(page, cols * rows, cols) == sum(1 for c in page if L.cells(c))
    for line in L.wrap(text.replace(X.DIM_ON, "").replace(X.DIM_OFF, ""), cols):
        assert sum(map(L.cells, line)) <= max(2, cols)
    assert "".join(L.wrap(text, cols)).replace(" ", "") == "".join(text.split())


def brute_wrap(words, width):
    """Every way of breaking a list of words is tried word by word: the line takes one more while it fits."""
    lines, i = [], 0
    words = [w[k : k + width] for w in words for k in range(0, len(w), width)] if any(len(w) > width for w in words) else words
    while i < len(words):
        j = i + 1
        while j < len(words) and len(" ".join(words[i : j + 1])) <= width:
            j += 1
        lines.append(" ".join(words[i:j]))
        i = j
    return lines


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), max_size=30), st.integers(6, 12), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_wrapping_and_columns_equal_brute_force(words, width, rows):
    text = " ".join(words)
    lines = brute_wrap(words, width)
    assert L.wrap(text, width) == lines
    assert L.doc_pages(text, width, rows) == ["\n".join(lines[i : i + 2 * rows]) for i in range(0, len(lines), 2 * rows)]
    dimmed = f"{text} {X.DIM_ON}{text}"
    open_at = [X.DIM_ON in "".join(p.replace(X.DIM_ON, "", 1) if p.startswith(X.DIM_ON) else p for p in [page]) or page.startswith(X.DIM_ON) for page in L.carry_dim(L.doc_pages(dimmed, width, rows))]
    assert open_at == sorted(open_at)  # once open, each later page opens dim


def test_dim_words_in_python_and_spark(spark):
    texts = ["The cat and THE dog", f"a {X.DIM_ON}the{X.DIM_OFF} the", "thé the-the", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.dim_stopwords("t").alias("d")).collect()
    assert {r.i: r.d for r in rows} == {i: L.dim_words(t) for i, t in enumerate(texts)}


def test_layout_columns(spark):
    text = "word " * 100
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = df.select(L.wrapped(F.col("t"), 20).alias("w"), L.paginated(F.col("t"), 40, 10).alias("p"), L.paginated_narrow(F.col("t"), 40).alias("n"), L.folded(F.col("t")).alias("f"), L.two_column_pages(F.col("t"), 20, 3).alias("d")).collect()
    assert rows[0].w == L.wrap(text, 20) and rows[0].p == rows[0].n == [text[i : i + 40] for i in range(0, 500, 40)] and len(rows[0].d) == 5
    assert rows[1].w is None and rows[2].p == rows[2].n == [] and rows[2].f.graphic == 0
    on, off = X.DIM_ON, X.DIM_OFF
    assert L.carry_dim([f"a{on}b", "c", f"d{off}e", "f"]) == [f"a{on}b", f"{on}c", f"{on}d{off}e", "f"]
    assert unicodedata.normalize("NFKD", "ﬁ") == "fi"


@given(st.text(alphabet="ab é\n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_simple_texts_fold_as_others_do(text):
    other = L.fold(text + "\t漢")
    assert L.fold(text)[0] == other[0].removesuffix("漢").rstrip(" █")
