"""Queries over events of delegated runs; the event table stands for their NDJSON output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import TRIMMED
from ..model import read
from ..operators import events as E
from ..registry import query
from ..session import ship_package

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def base(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))


def lines(spark, sf_dir):
    """(run_id, ts, event_id, line): deltas, thinking, snapshots of tool output, ends; some lines are
    broken and some of unknown type."""
    return lines_of(base(spark, sf_dir))


def lines_of(rows):
    j = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k, id = F.col("k"), F.col("event_id")
    update = '{"type":"message_update","assistantMessageEvent":{"type":"'
    line = (
        F.when(id % 97 == 0, '{"type":')
        .when(id % 89 == 0, '{"type":"mystery"}')
        .when(F.col("event_type") == "click", j(update, 'text_delta","delta":"c', k, ' "}}'))
        .when((F.col("event_type") == "view") & (k % 9 == 0), update + 'thinking_delta","delta":"\\n\\t"}}')
        .when(F.col("event_type") == "view", j(update, 'thinking_delta","delta":"v', k, ' "}}'))
        .when(F.col("event_type") == "error", update + 'thinking_end"}}')
        .when(F.col("event_type") == "signup", j(update, 'text_end","content":"s', id, '"}}'))
        .when(id % 2 == 0, j('{"type":"tool_execution_update","toolCallId":"t', k % 3, '","partialResult":{"content":[{"type":"text","text":"', F.substr(F.lit(ALPHABET), F.lit(1), (1 + k % 26).cast("int")), F.when(k % 5 == 0, "\\n\\n").otherwise(""), '"}]}}'))
        .otherwise(j('{"type":"tool_execution_end","toolName":"bash","isError":', F.when(k % 2 == 0, "true").otherwise("false"), "}"))
    )
    return rows.select("run_id", "ts", "event_id", line.alias("line"))


def events(spark, sf_dir):
    return E.parse_events(lines(spark, sf_dir))


EV = f"""WITH b AS (SELECT user_id AS run_id, ts, event_id, event_type, value, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events),
ev AS (
  SELECT run_id, ts, event_id, k,
    CASE event_type WHEN 'click' THEN 'reply-delta' WHEN 'view' THEN 'thinking-delta' WHEN 'error' THEN 'thinking-end' WHEN 'signup' THEN 'reply-complete' ELSE CASE WHEN event_id % 2 = 0 THEN 'tool-update' ELSE 'tool-end' END END AS kind,
    CASE event_type WHEN 'click' THEN 'c' || k || ' ' WHEN 'view' THEN CASE WHEN k % 9 = 0 THEN chr(10) || chr(9) ELSE 'v' || k || ' ' END WHEN 'error' THEN '' WHEN 'signup' THEN 's' || event_id ELSE CASE WHEN event_id % 2 = 0 THEN left('{ALPHABET}', 1 + k % 26) || CASE WHEN k % 5 = 0 THEN chr(10) || chr(10) ELSE '' END ELSE '' END END AS text,
    CASE WHEN event_type NOT IN ('click', 'view', 'error', 'signup') AND event_id % 2 = 1 THEN 'bash' ELSE '' END AS tool_name,
    CASE WHEN event_type NOT IN ('click', 'view', 'error', 'signup') AND event_id % 2 = 0 THEN 't' || (k % 3) ELSE '' END AS call_id,
    event_type NOT IN ('click', 'view', 'error', 'signup') AND event_id % 2 = 1 AND k % 2 = 0 AS is_error
  FROM b WHERE event_id % 97 <> 0 AND event_id % 89 <> 0
)"""


@query(f"{EV} SELECT run_id, event_id, kind, text, tool_name, call_id, is_error FROM ev")
def delegate_events(spark, sf_dir):
    return events(spark, sf_dir).select("run_id", "event_id", "kind", "text", "tool_name", "call_id", "is_error")


@query(f"{EV} SELECT run_id, event_id, CASE kind WHEN 'tool-update' THEN CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END WHEN 'tool-end' THEN '[done] bash' || CASE WHEN is_error THEN ' (error)' ELSE '' END ELSE '[thinking] ' || text END AS line FROM ev WHERE kind IN ('tool-update', 'tool-end', 'thinking-delta')")
def activity_lines(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("run_id", "event_id", E.activity(rows).alias("line")).where("line is not null")


@query(f"{EV}, w AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY run_id, call_id ORDER BY ts, event_id), '') AS b FROM ev WHERE kind = 'tool-update') SELECT run_id, event_id, CASE WHEN starts_with(text, b) THEN substring(text, length(b) + 1) ELSE text END AS delta FROM w")
def tool_output_delta(spark, sf_dir):
    return E.tool_deltas(events(spark, sf_dir)).select("run_id", "event_id", "delta")


@query(f"{EV}, s AS (SELECT *, sum(CASE WHEN kind <> 'thinking-delta' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM ev) SELECT * FROM (SELECT run_id, CAST(segment AS BIGINT) AS segment, trim(string_agg(text, '' ORDER BY ts, event_id), '{TRIMMED}') AS thinking FROM s WHERE kind = 'thinking-delta' GROUP BY run_id, segment) x WHERE thinking <> ''")
def thinking_segments(spark, sf_dir):
    return E.thinking_segments(events(spark, sf_dir))


@query(f"{EV}, r AS (SELECT * FROM ev WHERE kind IN ('reply-delta', 'reply-complete')), d AS (SELECT *, sum(CASE WHEN kind = 'reply-complete' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM r) SELECT run_id, string_agg(text, '' ORDER BY ts, event_id) AS reply FROM d WHERE coalesce(later, 0) = 0 GROUP BY run_id")
def reply_text(spark, sf_dir):
    return E.replies(events(spark, sf_dir))


@query("SELECT run_id, event_id, gap / 1000000.0 AS gap_s FROM (SELECT user_id AS run_id, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) AS gap FROM events) g WHERE gap > 43200000000")
def idle_gaps(spark, sf_dir):
    """Silences of over twelve hours."""
    return E.idle_gaps(base(spark, sf_dir), 43_200)


@query("SELECT run_id, count(*) AS n_late, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_late FROM (SELECT user_id AS run_id, ts, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS d FROM events) x WHERE d > 864000000000 GROUP BY run_id")
def hard_limit(spark, sf_dir):
    """Events over ten days after their run's first."""
    return E.hard_limit(base(spark, sf_dir), 864_000)


CAUSE = "CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'exit' ELSE 'eof' END"


@query(f"SELECT user_id AS run_id, arg_min({CAUSE}, struct_pack(a := ts, b := event_id)) AS cause, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id, count(*) AS n_endings FROM events WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY user_id")
def finalize_once(spark, sf_dir):
    cause = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "exit").otherwise("eof")
    endings = base(spark, sf_dir).where(F.col("event_type").isin("error", "signup", "purchase")).withColumn("cause", cause)
    return E.finalize_once(endings)


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'wait' WHEN event_type = 'view' THEN 'consumed' WHEN k % 2 = 0 THEN 'inject' ELSE 'held' END AS channel FROM (SELECT *, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events) b")
def delivery_channel(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rows.select("event_id", E.delivery(F.col("event_type") == "click", F.col("event_type") == "view", F.col("k") % 2 == 0).alias("channel"))


@query("SELECT event_id, CAST(least(300, greatest(1, coalesce(CASE WHEN event_type <> 'error' THEN value * 10 END, 10))) AS DOUBLE) AS wait_s FROM events")
def wait_clamp(spark, sf_dir):
    asked = F.when(F.col("event_type") != "error", F.col("value") * 10)
    return base(spark, sf_dir).select("event_id", E.wait_clamp(asked).alias("wait_s"))


@query("SELECT event_id, CASE WHEN code = 0 OR (code IS NULL AND k % 2 = 0) THEN 'completed' ELSE 'failed' END AS status FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END AS code, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events) b")
def run_status(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 0)
    return base(spark, sf_dir).select("event_id", E.run_status(code, F.col("k") % 2 == 0).alias("status"))


@query("SELECT user_id AS run_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us FROM events GROUP BY user_id HAVING arg_max(event_type, struct_pack(a := ts, b := event_id)) <> 'signup'")
def running_runs(spark, sf_dir):
    """Runs whose last event isn't an end."""
    out = E.latest(base(spark, sf_dir), "event_type").where("event_type <> 'signup'")
    return out.select("run_id", "event_type", F.unix_micros("started_at").alias("started_us"))


@query("SELECT user_id AS run_id, max(value) AS most, arg_max(value, struct_pack(a := ts, b := event_id)) AS last, count(*) FILTER (WHERE event_type = 'click') AS n_clicks FROM events GROUP BY user_id")
def observation_summary(spark, sf_dir):
    return base(spark, sf_dir).groupBy("run_id").agg(F.max("value").alias("most"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "click").alias("n_clicks"))


def throttled(rows, seconds: int):
    """(run_id, ts, event_id) -> those that fire: the next no sooner than ``seconds`` after one that
    fired. Each run is sequential; a run is one task's."""
    ship_package(rows.sparkSession)

    def fire(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "event_id"])
        keep, last = [], None
        for us in pdf["us"].tolist():
            keep.append(last is None or us - last >= seconds * 1_000_000)
            last = us if keep[-1] else last
        return pdf[pd.Series(keep, index=pdf.index)][["run_id", "event_id", "us"]]

    return rows.select("run_id", "event_id", F.unix_micros("ts").alias("us")).groupBy("run_id").applyInPandas(fire, "run_id long, event_id long, us long")


@query("""WITH RECURSIVE e AS (SELECT user_id AS run_id, event_id, epoch_us(ts) AS us FROM events),
fired AS (
  SELECT run_id, arg_min(event_id, struct_pack(a := us, b := event_id)) AS event_id, min(us) AS us FROM e GROUP BY run_id
  UNION ALL
  SELECT f.run_id, arg_min(e.event_id, struct_pack(a := e.us, b := e.event_id)), min(e.us) FROM fired f JOIN e ON e.run_id = f.run_id AND e.us >= f.us + 864000000000 GROUP BY f.run_id
)
SELECT run_id, event_id, us FROM fired""")
def throttle(spark, sf_dir):
    """No sooner than ten days after the last that fired."""
    return throttled(base(spark, sf_dir), 864_000)
