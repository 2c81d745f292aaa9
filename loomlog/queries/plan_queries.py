"""Composite queries: search, restoring, compressing, turns, status, configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import token_estimate, truncate_ellipsis
from ..model import tokens_sql
from ..operators import blocks as B
from ..operators import search as S
from ..operators.messages import assign_refs, to_core
from ..plans import history as H
from ..plans.turn import run_turn
from ..registry import query
from ..session import settled
from ..sources.sessions import overlay_config, resolve_limit as limit_of
from .message_queries import ENTRIES_SQL, entries
from .block_queries import LIMIT, PROTECTED, RANGES, UNCOVERED, WITH, tables

TOK = tokens_sql("text")
REFS = "refs AS (SELECT *, printf('m%05d', row_number() OVER (PARTITION BY session_id ORDER BY seq, id)) AS ref FROM core)"
DOCS = f"""{REFS}, own AS (SELECT session_id, id, arg_min(block_id, pos) AS owner, arg_min(tier, pos) AS tier FROM mem GROUP BY session_id, id),
docs AS (
  SELECT r.session_id, 'message' AS kind, ref, role, text, {TOK} AS tokens, owner AS block_id, o.tier FROM refs r JOIN own o ON r.session_id = o.session_id AND r.id = o.id WHERE length(text) >= 2
  UNION ALL SELECT session_id, 'block', block_id, 'block', concat_ws(chr(10), topic, summary), CAST((length(summary) + 3) // 4 AS BIGINT), block_id, tier FROM blk
)"""
TERMS = ["the", "que", "der"]


@query(f"{WITH}, {DOCS} SELECT session_id, kind, ref, role, text, tokens, block_id, tier FROM docs")
def search_docs(spark, sf_dir):
    return S.search_docs(*(tables(spark, sf_dir)))


def bm25_sql(docs: str) -> str:
    terms = [f"len(list_filter(words, lambda w: w = '{t}'))" for t in TERMS]
    dfs = ", ".join(f"count(*) FILTER (WHERE list_contains(words, '{t}')) AS df{i}" for i, t in enumerate(TERMS))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {tf} * {S.K1 + 1} / ({tf} + {S.K1} * ({1 - S.B} + {S.B} * len(words) / mean))" for i, tf in enumerate(terms))
    return f"""tk AS (SELECT *, regexp_extract_all(lower(text), '{S.TERM}') AS words FROM {docs}),
st AS (SELECT session_id, count(*) AS n, avg(len(words)) AS mean, {dfs} FROM tk GROUP BY session_id),
sc AS (SELECT tk.*, round({score}, 6) AS score FROM tk JOIN st ON tk.session_id = st.session_id),
top AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, kind, ref) AS rank FROM sc WHERE score > 0)"""


@query(f"{WITH}, {DOCS}, {bm25_sql('docs')} SELECT session_id, rank, kind, ref, score FROM top WHERE rank <= 10")
def search_context(spark, sf_dir):
    """The ten best documents of each session."""
    top = S.top_k(S.bm25(S.search_docs(*tables(spark, sf_dir)), TERMS), 10)
    return top.select("session_id", F.col("rank").cast("long").alias("rank"), "kind", "ref", "score")


@query(f"{WITH}, {DOCS}, {bm25_sql('(SELECT * FROM docs WHERE kind = ' + chr(39) + 'block' + chr(39) + ')')} SELECT session_id, rank, ref, score FROM top WHERE rank <= 5")
def search_blocks(spark, sf_dir):
    docs = S.search_docs(*tables(spark, sf_dir)).where("kind = 'block'")
    return S.top_k(S.bm25(docs, TERMS), 5).select("session_id", F.col("rank").cast("long").alias("rank"), "ref", "score")


RESTORED = "res AS (SELECT m.session_id, m.block_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY c.seq) AS text, count(*) AS n FROM mem m JOIN core c ON m.session_id = c.session_id AND m.id = c.id WHERE m.block_id = 'b1' GROUP BY m.session_id, m.block_id)"


@query(f"{WITH}, {RESTORED} SELECT session_id, block_id, text, n, CASE WHEN session_id % 3 = 0 THEN 'inline' ELSE 'file' END AS mode FROM res")
def decompress_block(spark, sf_dir):
    """Inline in every third session; a file that is asked for wins over that."""
    messages, blocks, _ = tables(spark, sf_dir)
    path = F.when(F.col("session_id") % 3 == 2, "/tmp/b1.txt")
    wanted = blocks.where("block_id = 'b1'").select("session_id", "block_id", (F.col("session_id") % 3 != 1).alias("inline"), path.alias("to_file"))
    return H.restore_blocks(wanted, blocks, messages).select("session_id", "block_id", "text", "n", "mode")


def promoted(spark, sf_dir):
    """Blocks after the first two of each session went into one, and that one and the fourth into another."""
    messages, blocks, _ = tables(spark, sf_dir)
    rows = messages.withColumn("protected", F.col("seq") == 1)
    for upto in (1, 3):
        ranges = B.active(blocks).where(F.col("created_at") <= upto).groupBy("session_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        ranges = ranges.withColumns({"by_blocks": F.lit(True), "topic": F.lit("tier"), "summary": F.concat(F.lit("up to "), F.lit(upto))})
        blocks = H.apply_compression(blocks, H.compress_ranges(ranges, rows, blocks, model.members(blocks), 0))
        # a new block is as new as what it holds, so that the next step finds it
        blocks = settled(blocks.withColumn("created_at", F.when(F.size("inner_ids") > 0, 0).otherwise(F.col("created_at"))), "promoted")
    newest = blocks.where("size(inner_ids) > 0 and active").select("session_id", "block_id")
    return messages, blocks, newest


# what the last block of a session holds: all turns of its blocks but one, some blocks inactive
_LAST = """act4 AS (SELECT * FROM blk WHERE active AND created_at <= 3),
rg AS (SELECT session_id, min(lo) AS lo, max(hi) AS hi FROM act4 GROUP BY session_id),
r1 AS (SELECT session_id, min(lo) AS lo, max(hi) AS hi FROM act4 WHERE created_at <= 1 GROUP BY session_id),
ids AS (
  SELECT c.session_id, c.id FROM rg JOIN core c ON c.session_id = rg.session_id AND c.seq BETWEEN lo AND hi WHERE c.seq <> 1
  UNION SELECT m.session_id, m.id FROM mem m JOIN act4 a ON a.session_id = m.session_id AND a.block_id = m.block_id
),
np AS (SELECT session_id, max(pos) AS p FROM blk GROUP BY session_id)"""


@query(f"""{WITH}, {_LAST}
SELECT i.session_id, 'b' || (any_value(p) + CASE WHEN any_value(r1.session_id) IS NULL THEN 2 ELSE 3 END) AS block_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY seq) AS text, count(*) AS n
FROM ids i JOIN core c ON c.session_id = i.session_id AND c.id = i.id JOIN np ON np.session_id = i.session_id LEFT JOIN r1 ON r1.session_id = i.session_id GROUP BY i.session_id""")
def decompress_full(spark, sf_dir):
    """All messages of a block and of those in it, two tiers deep; a protected one that no block had stays out."""
    messages, blocks, newest = promoted(spark, sf_dir)
    return H.restore_blocks(newest, blocks, messages, full=True).select("session_id", "block_id", "text", "n")


@query(f"{WITH}, {REFS} SELECT session_id, ref, CASE WHEN length(text) >= 2000 THEN 'file' ELSE 'inline' END AS mode, CASE WHEN length(text) >= 2000 THEN left(text, 600) || chr(10) || '[+' || (length(text) - 600) || ' more characters]' ELSE text END AS shown FROM refs WHERE ref = 'm00002'")
def decompress_message(spark, sf_dir):
    messages = assign_refs(model.core(spark, sf_dir))
    wanted = messages.select("session_id").distinct().withColumn("ref", F.lit("m00002"))
    return H.restore_messages(wanted, messages).select("session_id", "ref", "mode", "shown")


LEAST = 400


def made(spark, sf_dir):
    """Each session compresses its turns 0 to 3, with a zone of one message or 50 tokens; protected
    messages in there stay in view."""
    messages, blocks, members = tables(spark, sf_dir)
    rows = B.protected(messages, 1, 50).withColumn("protected", F.coalesce("protected", F.lit(False)))
    ranges = messages.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("lo"), F.lit(3).cast("long").alias("hi"), F.lit(False).alias("by_blocks"), F.lit("all").alias("topic"), F.lit("folded").alias("summary"))
    return H.compress_ranges(ranges, rows, blocks, members, LEAST), blocks, members, rows


ZONE = PROTECTED.replace("<= 2 OR", "<= 1 OR").replace("<= 200", "<= 50")
MADE = f"""{ZONE}, ins AS (SELECT session_id, id, text, coalesce(protected, false) AS p, {TOK} AS t FROM prot WHERE seq BETWEEN 0 AND 3),
hel AS (SELECT session_id, count(*) FILTER (WHERE NOT p) AS n_messages, count(*) FILTER (WHERE p) AS n_protected, CAST(coalesce(sum(length(text)) FILTER (WHERE NOT p), 0) AS BIGINT) AS chars, CAST(coalesce(sum(t) FILTER (WHERE NOT p), 0) AS BIGINT) AS tokens,
  CAST(coalesce(sum(t) FILTER (WHERE NOT p AND NOT EXISTS (SELECT 1 FROM mem WHERE mem.active AND mem.session_id = ins.session_id AND mem.id = ins.id)), 0) AS BIGINT) AS reclaimed FROM ins GROUP BY session_id),
eat AS (SELECT session_id, string_agg(block_id, ',' ORDER BY block_id) AS consumed FROM blk WHERE active AND lo >= 0 AND hi <= 3 GROUP BY session_id),
md AS (SELECT u.session_id, coalesce(n_messages, 0) AS n_messages, coalesce(n_protected, 0) AS n_protected, coalesce(tokens, 0) AS tokens, coalesce(consumed, '') AS consumed, CASE WHEN coalesce(n_messages, 0) = 0 THEN 'empty range' WHEN chars < {LEAST} THEN 'range too short' END AS error, u.tokens AS before, coalesce(reclaimed, 0) AS reclaimed
  FROM usage u LEFT JOIN hel h ON u.session_id = h.session_id LEFT JOIN eat e ON u.session_id = e.session_id)"""


@query(f"{WITH}, {UNCOVERED}, {MADE.replace('coalesce(tokens, 0) AS tokens', 'coalesce(h.tokens, 0) AS tokens')} SELECT session_id, n_messages, n_protected, tokens, consumed, error, before, CAST(greatest(0, before - CASE WHEN error IS NULL THEN reclaimed ELSE 0 END) AS BIGINT) AS after FROM md")
def compress_ranges(spark, sf_dir):
    out = made(spark, sf_dir)[0]
    return out.select("session_id", "n_messages", "n_protected", "tokens", F.array_join("consumed", ",").alias("consumed"), "error", "before", F.col("after").cast("long").alias("after"))


@query(f"""{WITH}, {UNCOVERED}, {MADE.replace('coalesce(tokens, 0) AS tokens', 'coalesce(h.tokens, 0) AS tokens')},
gone AS (SELECT i.session_id, i.id FROM ins i JOIN md ON md.session_id = i.session_id WHERE error IS NULL AND NOT p)
SELECT session_id, count(*) AS n_visible, CAST(coalesce(sum({TOK}), 0) AS BIGINT) AS tokens FROM unc u WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = u.session_id AND g.id = u.id) GROUP BY session_id""")
def view_after_compress(spark, sf_dir):
    """What is in view after :func:`compress_ranges`: all that was, but for what the new blocks hold."""
    out, blocks, _, rows = made(spark, sf_dir)
    after = H.apply_compression(blocks, out)
    left = B.uncovered(rows.select("session_id", "id", token_estimate("text").alias("t")), model.members(after))
    return left.groupBy("session_id").agg(F.count("*").alias("n_visible"), F.sum("t").cast("long").alias("tokens"))


@query(f"""{WITH}, b2 AS (SELECT session_id, min(lo) AS lo, max(hi) AS hi FROM blk WHERE active AND created_at <= 1 GROUP BY session_id),
ate AS (SELECT b.session_id, b.block_id FROM blk b JOIN b2 ON b.session_id = b2.session_id WHERE b.active AND b.lo >= b2.lo AND b.hi <= b2.hi),
mx AS (SELECT session_id, max(pos) AS p FROM blk GROUP BY session_id)
SELECT b.session_id, b.block_id, b.tier, b.active AND a.block_id IS NULL AS active FROM blk b LEFT JOIN ate a ON a.session_id = b.session_id AND a.block_id = b.block_id
UNION ALL SELECT b2.session_id, 'b' || (p + 2), CAST(2 AS BIGINT), true FROM b2 JOIN mx ON b2.session_id = mx.session_id""")
def tier_promotion(spark, sf_dir):
    """The first two blocks of each session become one block of the next tier."""
    messages, blocks, members = tables(spark, sf_dir)
    rows = messages.withColumn("protected", F.lit(False))
    ranges = B.active(blocks).where("created_at <= 1").groupBy("session_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = ranges.withColumn("by_blocks", F.lit(True)).withColumn("topic", F.lit("tier")).withColumn("summary", F.lit("folded"))
    out = H.apply_compression(blocks, H.compress_ranges(ranges, rows, blocks, members, 0))
    return out.select("session_id", "block_id", "tier", "active")


@query(f"""{WITH}, {UNCOVERED}, {RANGES},
tops AS (SELECT session_id, arg_max(lo, struct_pack(a := tokens, b := -lo)) AS top_lo, arg_max(hi, struct_pack(a := tokens, b := -lo)) AS top_hi, max(tokens) AS top_tokens FROM rng WHERE NOT protected GROUP BY session_id)
SELECT u.session_id, u.tokens, coalesce(n, 0) AS n_visible, coalesce(top_lo, -1) AS top_lo, coalesce(top_hi, -1) AS top_hi, u.tokens / {float(LIMIT // 8)} >= 0.8 AS emergency, top_tokens IS NOT NULL AND u.tokens / {float(LIMIT // 8)} >= 0.4 AS should_nudge,
  coalesce(k.id, CAST(u.session_id AS VARCHAR)) AS turn_key, top_tokens IS NOT NULL AND u.tokens / {float(LIMIT // 8)} >= 0.4 AND (u.tokens / {float(LIMIT // 8)} >= 0.8 OR u.session_id % 3 <> 0) AS inject
FROM usage u LEFT JOIN (SELECT session_id, arg_max(id, seq) AS id FROM core WHERE role = 'user' GROUP BY session_id) k ON u.session_id = k.session_id LEFT JOIN (SELECT session_id, count(*) AS n FROM unc GROUP BY session_id) c ON u.session_id = c.session_id LEFT JOIN tops t ON u.session_id = t.session_id""")
def turn_pipeline(spark, sf_dir):
    """In every third session the nudge of its last user message has been shown."""
    messages, blocks, members = tables(spark, sf_dir)
    shown = messages.where("role = 'user' and session_id % 3 = 0").groupBy("session_id").agg(F.max_by("id", "seq").alias("turn_key"))
    out = run_turn(messages, blocks, members, LIMIT // 8, 2, 200, shown=shown)["nudges"]
    return out.select("session_id", "tokens", "n_visible", F.coalesce("top_lo", F.lit(-1)).alias("top_lo"), F.coalesce("top_hi", F.lit(-1)).alias("top_hi"), "emergency", "should_nudge", "turn_key", "inject")


_HIDDEN = "coalesce(tool_call_id, '') = 'c0' AND seq % 8 >= 4 AND session_id % 2 = 0"
_TURN = f"""tk AS (SELECT session_id, sum({TOK}) AS t FROM pc GROUP BY session_id),
vis AS (SELECT p.*, printf('m%05d', row_number() OVER (PARTITION BY p.session_id ORDER BY seq, id)) AS ref, t / 100.0 >= 0.8 AS emergency FROM pc p JOIN tk ON tk.session_id = p.session_id),
cut AS (SELECT *, CASE WHEN emergency AND role = 'tool' AND length(text) > 4 THEN left(text, 2) || ' […' || (length(text) - 4) || 'ch elided…] ' || right(text, 2) ELSE text END AS shown FROM vis),
bod AS (SELECT *, regexp_replace(shown, '\\n+\\z', '') AS body FROM cut)"""


@query(f"""WITH {ENTRIES_SQL}, {_TURN} SELECT session_id, id, ref, CASE WHEN role = 'assistant' THEN shown WHEN body = '' THEN '[' || ref || ']' ELSE body || chr(10) || chr(10) || '[' || ref || ']' END AS tagged FROM bod WHERE NOT ({_HIDDEN})""")
def turn_messages(spark, sf_dir):
    """What the model gets in a turn: some calls of even sessions are hidden, and in sessions close to
    a limit of 100 tokens tool results of over four characters are cut."""
    messages = to_core(entries(spark, sf_dir)).drop("part")
    blocks = model.blocks(spark, sf_dir).limit(0)
    # calls are named alike in all turns here, so rows are hidden by their own ids
    hidden = messages.where((F.col("tool_call_id") == "c0") & (F.col("seq") % 8 >= 4) & (F.col("session_id") % 2 == 0)).select("session_id", F.col("id").alias("call_id"))
    out = run_turn(messages, blocks, model.members(blocks), 100, 2, 200, hidden_calls=hidden, most=4)["visible"]
    return out.select("session_id", "id", "ref", "tagged")


@query(f"""{WITH}, n AS (SELECT session_id, seq, max(CASE WHEN role = 'user' THEN id END) FILTER (WHERE role = 'user') OVER (PARTITION BY session_id ORDER BY seq) AS x, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k, seq % 4 = 3 AS emergency FROM core)
SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(k, CAST(session_id AS VARCHAR)) ORDER BY seq) AS r FROM n) m WHERE r = 1 OR emergency""")
def nudge_dedupe(spark, sf_dir):
    """A nudge each turn shows once for each user message, emergencies always."""
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = model.core(spark, sf_dir).withColumn("k", F.last(F.when(F.col("role") == "user", F.col("id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("session_id", F.coalesce("k", F.col("session_id").cast("string"))).orderBy("seq")) == 1
    return rows.withColumn("first", first).where(F.col("first") | (F.col("seq") % 4 == 3)).select("session_id", "seq")


@query(f"""{WITH}, {UNCOVERED}, tot AS (SELECT session_id, count(*) AS n_blocks, count(*) FILTER (WHERE active) AS n_active FROM blk GROUP BY session_id)
SELECT u.session_id, u.tokens, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_active, 0) AS n_active, coalesce(n, 0) AS n_visible FROM usage u LEFT JOIN tot ON u.session_id = tot.session_id LEFT JOIN (SELECT session_id, count(*) AS n FROM unc GROUP BY session_id) c ON u.session_id = c.session_id""")
def status_overview(spark, sf_dir):
    messages, blocks, members = tables(spark, sf_dir)
    visible = B.uncovered(messages, members).groupBy("session_id").agg(F.count("*").alias("n_visible"))
    out = B.uncovered_tokens(messages, members).join(B.totals(blocks).select("session_id", "n_blocks", "n_active"), "session_id", "left").join(visible, "session_id", "left")
    return out.na.fill(0, ["n_blocks", "n_active", "n_visible"]).select("session_id", "tokens", "n_blocks", "n_active", "n_visible")


@query(f"{WITH}, {UNCOVERED}, l AS (SELECT session_id, id, role, {TOK} AS tokens, CASE WHEN length(text) <= 48 THEN text ELSE left(text, 47) || '…' END AS preview, row_number() OVER (PARTITION BY session_id ORDER BY {TOK} DESC, seq) AS rank FROM unc) SELECT session_id, rank, id, role, tokens, preview FROM l WHERE rank <= 30")
def status_messages(spark, sf_dir):
    """The thirty largest messages in view of each session."""
    messages, _, members = tables(spark, sf_dir)
    rows = B.uncovered(messages, members).withColumn("tokens", token_estimate("text"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("tokens"), "seq"))
    rows = rows.withColumn("rank", rank.cast("long")).where("rank <= 30")
    return rows.select("session_id", "rank", "id", "role", "tokens", truncate_ellipsis("text", 48).alias("preview"))


@query(f"{WITH} SELECT session_id, block_id, tier, active, compressed_tokens, CAST((length(summary) + 3) // 4 AS BIGINT) AS summary_tokens, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, pos DESC) AS age FROM blk")
def status_blocks(spark, sf_dir):
    rows = model.blocks(spark, sf_dir)
    age = F.row_number().over(B.newest_first()).cast("long")
    return rows.select("session_id", "block_id", "tier", "active", F.col("compressed_tokens").cast("long").alias("compressed_tokens"), F.floor((F.length("summary") + 3) / 4).cast("long").alias("summary_tokens"), age.alias("age"))


LAYERS = [(0, "contextLimit", "150000"), (0, "hotBlocks", "6"), (1, "contextLimit", "90000"), (1, "unknown", "x"), (2, "snap", "auto"), (2, "hotBlocks", None), (2, "bashTimeout", "90")]


@query("SELECT key, arg_max(value, layer) AS value, CAST(max(layer) AS BIGINT) AS layer FROM (VALUES (0, 'contextLimit', '150000'), (0, 'hotBlocks', '6'), (1, 'contextLimit', '90000'), (1, 'unknown', 'x'), (2, 'snap', 'auto'), (2, 'hotBlocks', NULL), (2, 'bashTimeout', '90')) v(layer, key, value) WHERE value IS NOT NULL AND key <> 'unknown' GROUP BY key")
def config_overlay(spark, sf_dir):
    return overlay_config(spark.createDataFrame(LAYERS, "layer long, key string, value string"))


@query("SELECT event_id, CAST(coalesce(CASE WHEN e > 0 THEN e END, CASE WHEN a > 0 THEN a END, CASE WHEN w > 0 THEN w END, 150000) AS BIGINT) AS context_limit FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN event_id % 3 END AS e, CASE WHEN event_type <> 'view' THEN event_id % 2 - 1 + user_id % 2 END AS a, event_id % 5 AS w FROM events) x")
def resolve_limit(spark, sf_dir):
    rows = model.read(spark, sf_dir, "events")
    env = F.when(F.col("event_type") == "click", F.col("event_id") % 3)
    adapter = F.when(F.col("event_type") != "view", F.col("event_id") % 2 - 1 + F.col("user_id") % 2)
    return rows.select("event_id", limit_of(env, adapter, F.col("event_id") % 5).alias("context_limit"))


@query("SELECT event_type, array_to_string(list_sort(list_distinct([event_type, 'read', 'bash', 'view', 'grep'])), ',') AS tools FROM (SELECT DISTINCT event_type FROM events) e")
def array_union_tools(spark, sf_dir):
    """Allow lists merged without repeats."""
    rows = model.read(spark, sf_dir, "events").select("event_type").distinct()
    both = F.array_union(F.array(F.col("event_type"), F.lit("read"), F.lit("bash")), F.array(F.lit("bash"), F.lit("view"), F.lit("grep")))
    return rows.select("event_type", F.array_join(F.sort_array(both), ",").alias("tools"))
