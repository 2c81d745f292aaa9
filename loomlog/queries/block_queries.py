"""Queries over messages in view, blocks and what they cover."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import TRIMMED, quarter_tokens, token_estimate
from ..model import tokens_sql
from ..operators import archive as A
from ..operators import blocks as B
from ..operators.messages import assign_refs as number_refs
from ..registry import query

WITH = f"WITH {model.SQL}"
TOK = tokens_sql("text")
LIMIT = 4000


def tables(spark, sf_dir):
    messages, blocks = model.core(spark, sf_dir), model.blocks(spark, sf_dir)
    return messages, blocks, model.members(blocks)


def archived(blocks):
    """Stands for the archive list: every fourth block."""
    return blocks.where(F.col("created_at") % 4 == 0).select("session_id", "block_id")


@query(f"{WITH} SELECT session_id, id, seq, role, text FROM core")
def scan_entries(spark, sf_dir):
    return model.core(spark, sf_dir).select("session_id", "id", "seq", "role", "text")


UNCOVERED = f"""unc AS (
  SELECT c.* FROM core c WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.active AND m.session_id = c.session_id AND m.id = c.id)
),
usage AS (
  SELECT s.session_id, CAST(coalesce(t, 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT session_id FROM core) s
  LEFT JOIN (SELECT session_id, sum({TOK}) AS t FROM unc GROUP BY session_id) u ON s.session_id = u.session_id
)"""


@query(f"{WITH}, {UNCOVERED} SELECT session_id, tokens FROM usage")
def uncovered_tokens(spark, sf_dir):
    messages, _, members = tables(spark, sf_dir)
    return B.uncovered_tokens(messages, members)


@query(f"{WITH}, {UNCOVERED} SELECT session_id, tokens, CAST({LIMIT} AS BIGINT) AS token_limit, CAST(floor(tokens * 100.0 / {LIMIT} + 0.5) AS BIGINT) AS percent FROM usage")
def context_usage(spark, sf_dir):
    """The flagship: tokens in view of each session, and their share of the limit."""
    messages, _, members = tables(spark, sf_dir)
    percent = F.when(F.lit(LIMIT > 0), F.floor(F.col("tokens") * 100.0 / LIMIT + 0.5)).otherwise(0)
    return B.uncovered_tokens(messages, members).withColumn("token_limit", F.lit(LIMIT).cast("long")).withColumn("percent", percent.cast("long"))


@query(f"{WITH} SELECT DISTINCT c.session_id, c.id, c.seq FROM core c JOIN mem m ON m.session_id = c.session_id AND m.id = c.id WHERE length(text) >= 2")
def searchable_messages(spark, sf_dir):
    messages, _, members = tables(spark, sf_dir)
    return B.covered(messages, members).where(F.length("text") >= 2).select("session_id", "id", "seq")


OVERLAP = """ov AS (SELECT session_id, id, block_id, pos, tier FROM mem UNION ALL
  SELECT session_id, id, 'o' || pos, CASE WHEN pos % 2 = 1 THEN pos - 1 ELSE pos + 1 END, 2 FROM mem)"""


@query(f"{WITH}, {OVERLAP} SELECT session_id, id, arg_min(block_id, struct_pack(a := pos, b := block_id)) AS owner, arg_min(tier, struct_pack(a := pos, b := block_id)) AS tier FROM ov GROUP BY session_id, id")
def message_owner(spark, sf_dir):
    """First match among overlapping blocks: each block also exists one place earlier or later."""
    _, blocks, members = tables(spark, sf_dir)
    place = F.when(F.col("pos") % 2 == 1, F.col("pos") - 1).otherwise(F.col("pos") + 1)
    twins = blocks.withColumns({"block_id": F.concat(F.lit("o"), "pos"), "pos": place, "tier": F.lit(2).cast("long")})
    return B.owners(members.unionByName(model.members(twins)))


@query(f"{WITH} SELECT session_id, block_id, id FROM mem")
def block_members(spark, sf_dir):
    return tables(spark, sf_dir)[2].select("session_id", "block_id", "id")


@query(f"""{WITH} SELECT m.session_id, m.block_id, min(m.seq) AS lo, count(*) AS n, CAST(sum({TOK}) AS BIGINT) AS tokens
FROM mem m JOIN core c ON m.session_id = c.session_id AND m.id = c.id GROUP BY m.session_id, m.block_id""")
def range_members(spark, sf_dir):
    """Ranges of messages and what is in them."""
    messages, _, members = tables(spark, sf_dir)
    counted = messages.select("session_id", "id", "seq", token_estimate("text").alias("t"))  # no texts in the shuffle
    rows = members.select("session_id", "block_id", "id").join(counted, ["session_id", "id"])
    return rows.groupBy("session_id", "block_id").agg(F.min("seq").alias("lo"), F.count("*").alias("n"), F.sum("t").cast("long").alias("tokens"))


ACTIVE = "act AS (SELECT * FROM blk WHERE active)"
COLD = f"{ACTIVE}, cold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, pos DESC) AS age FROM act) t WHERE age > 1)"
UNSNAPPED = f"{COLD}, uns AS (SELECT * EXCLUDE (age) FROM cold WHERE created_at % 4 <> 0)"


@query(f"{WITH}, {COLD} SELECT session_id, block_id, created_at FROM cold")
def cold_blocks(spark, sf_dir):
    return B.cold(model.blocks(spark, sf_dir), 1).select("session_id", "block_id", "created_at")


@query(f"{WITH}, {UNSNAPPED} SELECT session_id, block_id FROM uns")
def unsnapped_cold(spark, sf_dir):
    blocks = model.blocks(spark, sf_dir)
    return B.unsnapped(B.cold(blocks, 1), archived(blocks)).select("session_id", "block_id")


@query(f"{WITH}, {UNSNAPPED} SELECT session_id, block_id FROM uns WHERE session_id IN (SELECT session_id FROM uns GROUP BY session_id HAVING sum((length(summary) + 3) // 4) >= 30)")
def snap_candidates(spark, sf_dir):
    blocks = model.blocks(spark, sf_dir)
    return B.gate(B.unsnapped(B.cold(blocks, 1), archived(blocks)), 30).select("session_id", "block_id")


@query(f"{WITH}, {UNSNAPPED}, {UNCOVERED} SELECT session_id, block_id FROM uns WHERE session_id IN (SELECT session_id FROM uns GROUP BY session_id HAVING sum((length(summary) + 3) // 4) >= 1000000) OR session_id IN (SELECT session_id FROM usage WHERE tokens * 1.0 / 100 >= 0.8)")
def overflow_candidates(spark, sf_dir):
    """A session close to its limit archives whatever is pending."""
    messages, blocks, members = tables(spark, sf_dir)
    usage = B.uncovered_tokens(messages, members).select("session_id", (F.col("tokens") / 100).alias("usage"))
    return B.gate(B.unsnapped(B.cold(blocks, 1), archived(blocks)), 1_000_000, usage).select("session_id", "block_id")


@query(f"{WITH} SELECT session_id, block_id, 'call-' || block_id AS hidden_call FROM blk WHERE active AND created_at % 4 = 0")
def snapped_view(spark, sf_dir):
    blocks = model.blocks(spark, sf_dir)
    return B.snapped_view(blocks, archived(blocks)).select("session_id", "block_id", F.concat(F.lit("call-"), "block_id").alias("hidden_call"))


@query(f"{WITH} SELECT session_id, CAST(sum((length(summary) + 3) // 4) AS BIGINT) AS tokens FROM blk WHERE active GROUP BY session_id")
def summary_tokens(spark, sf_dir):
    return B.active(model.blocks(spark, sf_dir)).groupBy("session_id").agg(F.sum(quarter_tokens("summary")).cast("long").alias("tokens"))


TOTALS = "SELECT session_id, count(*) AS n_blocks, count(*) FILTER (WHERE active) AS n_active, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, CAST(sum((length(summary) + 3) // 4) AS BIGINT) AS summary_tokens FROM blk GROUP BY session_id"


@query(f"{WITH} {TOTALS}")
def block_totals(spark, sf_dir):
    return B.totals(model.blocks(spark, sf_dir))


TIERED = "tb AS (SELECT * REPLACE (1 + created_at % 2 AS tier) FROM blk WHERE active)"


@query(f"{WITH}, {TIERED} SELECT session_id, string_agg('T' || tier || ':' || n, ' ' ORDER BY tier) AS tiers FROM (SELECT session_id, tier, count(*) AS n FROM tb GROUP BY session_id, tier) t GROUP BY session_id")
def tier_counts(spark, sf_dir):
    return B.tier_counts(model.blocks(spark, sf_dir).withColumn("tier", 1 + F.col("created_at") % 2))


@query(f"{WITH} SELECT session_id, count(DISTINCT id) AS n_covered FROM mem WHERE active GROUP BY session_id")
def covered_count(spark, sf_dir):
    members = tables(spark, sf_dir)[2]
    return B.active(members).groupBy("session_id").agg(F.count_distinct("id").alias("n_covered"))


# a block's transcript: neighbours of one role run together
SNAPSHOTS = f"""said AS (
  SELECT m.session_id, m.block_id, c.seq, CASE WHEN role = 'user' THEN '¶user:' ELSE '¶ai:' END AS scope, text
  FROM mem m JOIN core c ON m.session_id = c.session_id AND m.id = c.id WHERE role = 'assistant' OR text <> ''
),
lined AS (SELECT *, lag(scope) OVER o AS b, lag(text) OVER o AS bt FROM said WINDOW o AS (PARTITION BY session_id, block_id ORDER BY seq)),
snaps AS (
  SELECT b.session_id, b.block_id, b.tier, b.topic, b.created_at, b.pos,
    CASE WHEN trim(coalesce(source, ''), '{TRIMMED}') <> '' THEN trim(source, '{TRIMMED}') ELSE trim(summary, '{TRIMMED}') END AS body
  FROM blk b LEFT JOIN (
    SELECT session_id, block_id, string_agg(CASE WHEN b IS NULL THEN scope || text WHEN b = scope THEN CASE WHEN right(bt, 1) = chr(10) OR left(text, 1) = chr(10) THEN '' ELSE chr(10) END || text ELSE chr(10) || chr(10) || scope || text END, '' ORDER BY seq) AS source
    FROM lined GROUP BY session_id, block_id
  ) s ON b.session_id = s.session_id AND b.block_id = s.block_id WHERE active
)"""


@query(f"{WITH}, {SNAPSHOTS} SELECT session_id, block_id, tier, body FROM snaps")
def block_snapshots(spark, sf_dir):
    messages, blocks, members = tables(spark, sf_dir)
    return A.block_snapshots(blocks, members, messages).select("session_id", "block_id", "tier", "body")


@query(f"{WITH} SELECT session_id, id, printf('m%05d', row_number() OVER (PARTITION BY session_id ORDER BY seq, id)) AS ref FROM core")
def assign_refs(spark, sf_dir):
    return number_refs(model.core(spark, sf_dir)).select("session_id", "id", "ref")


@query(f"{WITH} SELECT session_id, arg_max(id, seq) AS id FROM core WHERE role = 'user' GROUP BY session_id")
def last_user_message(spark, sf_dir):
    return model.core(spark, sf_dir).where("role = 'user'").groupBy("session_id").agg(F.max_by("id", "seq").alias("id"))


@query(f"""{WITH}, t AS (SELECT session_id, seq, sum({TOK}) OVER (PARTITION BY session_id ORDER BY seq) AS tokens FROM core)
SELECT session_id, seq, CAST(tokens AS BIGINT) AS tokens, CAST(tokens - coalesce(last_value(CASE WHEN seq % 3 = 0 THEN tokens END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS growth FROM t""")
def context_growth(spark, sf_dir):
    """Tokens that came since the last nudge; a nudge stands at every third turn."""
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = model.core(spark, sf_dir).select("session_id", "seq", F.sum(token_estimate("text")).over(order).alias("tokens"))
    last = F.last(F.when(F.col("seq") % 3 == 0, F.col("tokens")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("session_id", "seq", F.col("tokens").cast("long"), (F.col("tokens") - F.coalesce(last, F.lit(0))).cast("long").alias("growth"))


PROTECTED = f"""prot AS (
  SELECT *, (row_number() OVER back <= 2 OR sum({TOK}) OVER back <= 200 OR seq = max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY session_id)) AS protected
  FROM core WINDOW back AS (PARTITION BY session_id ORDER BY seq DESC, id DESC)
)"""


@query(f"{WITH}, {PROTECTED} SELECT session_id, id, coalesce(protected, false) AS protected FROM prot")
def protected_zone(spark, sf_dir):
    """With a zone of 2 messages or 200 tokens, since test sessions are short."""
    return B.protected(model.core(spark, sf_dir), 2, 200).select("session_id", "id", F.coalesce("protected", F.lit(False)).alias("protected"))


RANGES = f"""{PROTECTED},
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, id) AS place FROM prot),
opened AS (SELECT p.* FROM placed p JOIN unc u ON p.session_id = u.session_id AND p.id = u.id),
starts AS (SELECT *, CASE WHEN protected IS NOT DISTINCT FROM lag(protected) OVER o AND place = lag(place) OVER o + 1 THEN 0 ELSE 1 END AS s FROM opened WINDOW o AS (PARTITION BY session_id ORDER BY place)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM starts),
rng AS (SELECT session_id, run, min(seq) AS lo, max(seq) AS hi, bool_or(protected) AS protected, CAST(sum({TOK}) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM runs GROUP BY session_id, run)"""


def open_ranges(spark, sf_dir):
    messages, _, members = tables(spark, sf_dir)
    return B.ranges(messages, members, 2, 200)


@query(f"{WITH}, {UNCOVERED}, {RANGES} SELECT session_id, lo, hi, protected, tokens, n FROM rng")
def ranges_report(spark, sf_dir):
    return open_ranges(spark, sf_dir).select("session_id", "lo", "hi", "protected", "tokens", "n")


@query(f"{WITH}, {UNCOVERED}, {RANGES} SELECT session_id, arg_max(lo, struct_pack(a := tokens, b := -lo)) AS lo, arg_max(hi, struct_pack(a := tokens, b := -lo)) AS hi, max(tokens) AS tokens FROM rng WHERE NOT protected GROUP BY session_id")
def top_range(spark, sf_dir):
    return B.top_range(open_ranges(spark, sf_dir))


@query(f"""{WITH} SELECT session_id, array_to_string((list(block_id ORDER BY created_at, pos))[1:2], ', ') || CASE WHEN count(*) > 2 THEN ' (+' || (count(*) - 2) || ' more)' ELSE '' END AS preview FROM blk WHERE active GROUP BY session_id""")
def block_id_preview(spark, sf_dir):
    """The first ids and how many more there are; two here, ten in a report."""
    rows = B.active(model.blocks(spark, sf_dir)).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "pos", "block_id"))).alias("b"))
    first = F.array_join(F.transform(F.slice("b", 1, 2), lambda x: x["block_id"]), ", ")
    more = F.when(F.size("b") > 2, F.concat(F.lit(" (+"), F.size("b") - 2, F.lit(" more)"))).otherwise("")
    return rows.select("session_id", F.concat(first, more).alias("preview"))


@query(f"{WITH} SELECT session_id, arg_min(block_id, created_at) AS first_id, arg_max(block_id, created_at) AS last_id, string_agg(block_id, ', ' ORDER BY created_at) AS ids FROM blk WHERE active GROUP BY session_id")
def distill_range(spark, sf_dir):
    rows = B.active(model.blocks(spark, sf_dir)).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "pos", "block_id"))).alias("b"))
    ids = F.transform("b", lambda x: x["block_id"])
    return rows.select("session_id", F.element_at(ids, 1).alias("first_id"), F.element_at(ids, -1).alias("last_id"), F.array_join(ids, ", ").alias("ids"))


@query(f"""{WITH}, tot AS ({TOTALS}) SELECT session_id, n_active || ' of ' || n_blocks || ' blocks active, ' || compressed_tokens || ' tokens folded into ' || summary_tokens AS summary FROM tot""")
def nudge_summary(spark, sf_dir):
    t = B.totals(model.blocks(spark, sf_dir))
    return t.select("session_id", F.concat("n_active", F.lit(" of "), "n_blocks", F.lit(" blocks active, "), "compressed_tokens", F.lit(" tokens folded into "), "summary_tokens").alias("summary"))


@query(f"""{WITH}, {UNCOVERED}, classed AS (SELECT session_id, CASE WHEN text LIKE '%[%' THEN 'code' ELSE role END AS class, {TOK} AS t FROM unc)
SELECT u.session_id, CAST(coalesce(sum(t) FILTER (WHERE class = 'code'), 0) AS BIGINT) AS code, CAST(coalesce(sum(t) FILTER (WHERE class = 'user'), 0) AS BIGINT) AS user_text,
  CAST(coalesce(sum(t) FILTER (WHERE class = 'assistant'), 0) AS BIGINT) AS assistant_text, any_value(coalesce(st, 0)) AS summaries, CAST(greatest(0, 500 + coalesce(sum(t), 0) + any_value(coalesce(st, 0)) - coalesce(sum(t), 0) - any_value(coalesce(st, 0)) - 100) AS BIGINT) AS framework
FROM usage u LEFT JOIN classed c ON u.session_id = c.session_id LEFT JOIN (SELECT session_id, CAST(sum((length(summary) + 3) // 4) AS BIGINT) AS st FROM blk WHERE active GROUP BY session_id) s ON u.session_id = s.session_id GROUP BY u.session_id""")
def context_breakdown(spark, sf_dir):
    """Tokens in view by class, and what a host adds: a measured total (500 more here) less what is
    classed and the system prompt (100 here)."""
    messages, blocks, members = tables(spark, sf_dir)
    t = token_estimate("text")
    kind = F.when(F.col("text").contains("["), "code").otherwise(F.col("role"))
    parts = B.uncovered(messages, members).withColumn("class", kind).groupBy("session_id").agg(*(F.sum(F.when(F.col("class") == c, t)).alias(n) for c, n in (("code", "code"), ("user", "user_text"), ("assistant", "assistant_text"))))
    sums = summary_tokens(spark, sf_dir).withColumnRenamed("tokens", "summaries")
    rows = messages.select("session_id").distinct().join(parts, "session_id", "left").join(sums, "session_id", "left").na.fill(0)
    classed = F.col("code") + F.col("user_text") + F.col("assistant_text") + F.col("summaries")
    return rows.withColumn("framework", F.greatest(F.lit(0), classed + 500 - classed - 100)).select("session_id", *(F.col(c).cast("long") for c in ("code", "user_text", "assistant_text", "summaries", "framework")))
