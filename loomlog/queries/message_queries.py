"""Queries over session entries and their projection.

The test table has plain turns only; :func:`entries` makes session entries of every kind of them:
system turns become custom messages, assistant turns call no, one or two tools by their number, and
a call of one tool gets a result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import archive as A
from ..operators import messages as M
from ..functions.text import TRIMMED
from ..registry import query
from ..sources.sessions import ENTRIES, merge_live


def _json(text):
    return F.expr(f"substring(to_json(named_struct('x', {text})), 6, length(to_json(named_struct('x', {text}))) - 6)")


def entries(spark, sf_dir):
    """(session_id, seq, type, id, content, message), the last two as JSON text."""
    # every sixth turn after the third says nothing but white space, which drops an assistant's
    said = "CASE WHEN turn % 6 = 3 THEN '\\n\\t ' ELSE coalesce(text, '') END"
    rows = model.read(spark, sf_dir, "conversations").withColumn("j", _json(said))
    calls = F.when(F.col("role") == "assistant", F.col("turn") % 3).otherwise(0)
    content = (
        F.when(calls == 1, F.concat(F.lit('[{"type":"text","text":'), "j", F.lit('},{"type":"toolCall","id":"c0","name":"bash","arguments":{"command":"ls"}}]')))
        .when(calls == 2, F.concat(F.lit('[{"type":"text","text":'), "j", F.lit('},{"type":"toolCall","id":"c1","name":"read","arguments":"a.txt"},{"type":"toolCall","id":"c2","name":"grep"}]')))
        .otherwise(F.col("j"))
    )
    id = F.concat_ws("-", "conv_id", "turn")
    custom = F.col("role") == "system"
    said = rows.select(
        F.col("conv_id").alias("session_id"), (2 * F.col("turn")).alias("seq"), F.when(custom, "custom_message").otherwise("message").alias("type"), id.alias("id"),
        F.when(custom, F.col("j")).alias("content"), F.when(~custom, F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), content, F.lit("}"))).alias("message"),
    )
    results = rows.where(calls == 1).select(
        F.col("conv_id").alias("session_id"), (2 * F.col("turn") + 1).alias("seq"), F.lit("message").alias("type"), F.concat(id, F.lit("-r")).alias("id"), F.lit(None).cast("string").alias("content"),
        F.concat(F.lit('{"role":"toolResult","toolCallId":"c0","toolName":"bash","content":[{"type":"text","text":"out '), "turn", F.lit('"}]}')).alias("message"),
    )
    return said.unionByName(results)


ENTRIES_SQL = f"""
raw AS (SELECT conv_id AS session_id, turn, conv_id || '-' || turn AS id, role, CASE WHEN turn % 6 = 3 THEN chr(10) || chr(9) || ' ' ELSE coalesce(text, '') END AS text, CASE WHEN role = 'assistant' THEN turn % 3 ELSE 0 END AS calls FROM conversations),
pc AS (
  SELECT session_id, 2 * turn AS seq, id, 'user' AS role, 'text' AS content_type, NULL AS tool_name, NULL AS tool_call_id, text FROM raw WHERE role = 'user' OR (role = 'system' AND text <> '')
  UNION ALL SELECT session_id, 2 * turn, id, 'assistant', 'text', NULL, NULL, text FROM raw WHERE role = 'assistant' AND calls = 0 AND trim(text, '{TRIMMED}') <> ''
  UNION ALL SELECT session_id, 2 * turn, id, 'assistant', 'tool-call', 'bash', 'c0', text || CASE WHEN text <> '' THEN chr(10) ELSE '' END || '{{"command":"ls"}}' FROM raw WHERE calls = 1
  UNION ALL SELECT session_id, 2 * turn, id || '#c1', 'assistant', 'tool-call', 'read', 'c1', 'a.txt' FROM raw WHERE calls = 2
  UNION ALL SELECT session_id, 2 * turn, id || '#c2', 'assistant', 'tool-call', 'grep', 'c2', text FROM raw WHERE calls = 2
  UNION ALL SELECT session_id, 2 * turn + 1, id || '-r', 'tool', 'tool-result', 'bash', 'c0', 'out ' || turn FROM raw WHERE calls = 1
)"""
WITH = f"WITH {ENTRIES_SQL}"
COLUMNS = ("session_id", "id", "seq", "role", "content_type", "tool_name", "tool_call_id", "text")


@query(f"{WITH} SELECT {', '.join(COLUMNS)} FROM pc")
def core_projection(spark, sf_dir):
    return M.to_core(entries(spark, sf_dir)).select(*COLUMNS)


@query(f"{WITH} SELECT session_id, id, tool_name, text FROM pc WHERE id LIKE '%#%'")
def split_tool_calls(spark, sf_dir):
    return M.to_core(entries(spark, sf_dir)).where(F.col("id").contains("#")).select("session_id", "id", "tool_name", "text")


@query(f"""WITH {model.SQL}, r AS (SELECT *, printf('m%05d', row_number() OVER (PARTITION BY session_id ORDER BY seq, id)) AS ref FROM core)
SELECT session_id, id, CASE WHEN role = 'assistant' THEN text WHEN body = '' THEN '[' || ref || ']' ELSE body || chr(10) || chr(10) || '[' || ref || ']' END AS tagged FROM (SELECT *, regexp_replace(text, '\\n+\\z', '') AS body FROM r) t""")
def tag_messages(spark, sf_dir):
    return M.tag(M.assign_refs(model.core(spark, sf_dir))).select("session_id", "id", "tagged")


@query(f"""{WITH}, live AS (SELECT *, split_part(id, '#', 1) AS base FROM pc WHERE NOT (coalesce(tool_call_id, '') = 'c2' AND seq % 4 = 0)),
surv AS (SELECT session_id, base, list(tool_call_id) AS calls FROM live WHERE id LIKE '%#%' GROUP BY session_id, base),
shown AS (SELECT session_id, base, min(seq) AS at FROM live WHERE NOT (coalesce(tool_call_id, '') = 'c0' AND seq % 8 >= 4 AND session_id % 2 = 0) GROUP BY session_id, base)
SELECT s.session_id, s.base AS id, s.at, CAST(CASE WHEN r.calls = 1 THEN 2 WHEN r.calls = 2 THEN 1 + len(surv.calls) ELSE 1 END AS BIGINT) AS n_parts
FROM shown s LEFT JOIN surv ON s.session_id = surv.session_id AND s.base = surv.base LEFT JOIN raw r ON r.session_id = s.session_id AND (r.id = s.base)""")
def rebuild_messages(spark, sf_dir):
    """Some second calls are pruned and some calls of even sessions hidden."""
    rows = entries(spark, sf_dir)
    core = M.to_core(rows)
    pruned = core.where(~(F.col("tool_call_id").eqNullSafe("c2") & (F.col("seq") % 4 == 0)))
    hidden = core.where(F.col("tool_call_id").eqNullSafe("c0") & (F.col("seq") % 8 >= 4) & (F.col("session_id") % 2 == 0))
    # calls are named alike in all turns here, so rows are hidden by their own ids
    hidden = hidden.select("session_id", F.col("id").alias("call_id"))
    parsed = rows.withColumn("v", F.coalesce(F.try_parse_json("message"), F.try_parse_json(F.concat(F.lit('{"content":'), "content", F.lit("}")))))
    parsed = parsed.select("session_id", "id", M.parse_content(F.col("v")).alias("parts"))
    out = M.rebuild(pruned, parsed, hidden)
    return out.select("session_id", "id", "at", F.size("parts").cast("long").alias("n_parts"))


@query(f"""{WITH} SELECT c.session_id, c.id, c.tool_call_id AS key, r.result FROM pc c LEFT JOIN (
  SELECT session_id, tool_call_id, arg_max(text, seq) AS result FROM pc WHERE role = 'tool' AND text <> '' GROUP BY session_id, tool_call_id
) r ON c.session_id = r.session_id AND c.tool_call_id = r.tool_call_id WHERE content_type = 'tool-call'""")
def call_result_pairs(spark, sf_dir):
    return A.call_result_pairs(M.to_core(entries(spark, sf_dir))).select("session_id", "id", "key", "result")


@query(f"""WITH {model.SQL}, p AS (
  SELECT session_id, seq, CASE WHEN role = 'user' THEN '¶user:' ELSE '¶ai:' END AS scope, text FROM core WHERE (role = 'user' AND text <> '') OR (role = 'assistant' AND trim(text, '{TRIMMED}') <> '')
), q AS (SELECT *, lag(scope) OVER o AS b, lag(text) OVER o AS bt FROM p WINDOW o AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, string_agg(CASE WHEN b IS NULL THEN scope || text WHEN b = scope THEN CASE WHEN right(bt, 1) = chr(10) OR left(text, 1) = chr(10) THEN '' ELSE chr(10) END || text ELSE chr(10) || chr(10) || scope || text END, '' ORDER BY seq) AS transcript
FROM q GROUP BY session_id""")
def serialize_transcript(spark, sf_dir):
    return A.serialize(model.core(spark, sf_dir))


@query(f"SELECT seq, type, id FROM (VALUES {', '.join(map(str, [(i, e[0], e[1]) for i, e in enumerate(ENTRIES)]))}) v(seq, type, id)")
def scan_session_log(spark, sf_dir):
    """A session log as written by a host: JSON lines with a sequence number."""
    from ..sources.sessions import literal_entries

    return literal_entries(spark).select("seq", "type", "id")


@query(f"""WITH {model.SQL} SELECT session_id, seq, CASE WHEN seq % 3 = 2 THEN 'live-' || (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) ELSE id END AS id, role, seq % 3 = 2 AS live FROM core""")
def merge_live_tail(spark, sf_dir):
    """Live messages, aligned in order with the persisted ones of the same role and content; every
    third message of a session is only live. Contents differ within a session here, so that each
    persisted message is met in its turn."""
    rows = model.core(spark, sf_dir)
    content = F.concat(F.lit('{"content":"'), F.sha2("text", 256), F.lit('"}'))
    live = rows.select("session_id", "seq", "role", content.alias("content"))
    persisted = rows.where(F.col("seq") % 3 != 2).select("session_id", "seq", "id", "role", content.alias("content"))
    return merge_live(persisted, live)
