"""Queries of the scalar functions, over whole texts of ``documents`` or over literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guardrails as G
from ..functions import layout as L
from ..functions import text as X
from ..model import read, tokens_sql
from ..registry import query


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 1200) || ' […' || (length(text) - 2000) || 'ch elided…] ' || right(text, 800) END AS shown FROM documents")
def truncate_head_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.truncate_head_tail("text").alias("shown"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS shown, CASE WHEN length(t) <= 48 THEN t ELSE left(t, 47) || '…' END AS line FROM (SELECT doc_id, text, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '{X.TRIMMED}') AS t FROM documents) d")
def truncate_ellipsis(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.truncate_ellipsis("text", 80).alias("shown"), X.one_line("text").alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 600) || chr(10) || '[+' || (length(text) - 600) || ' more characters]' END AS shown FROM documents")
def head_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.head_preview("text").alias("shown"))


def cap_sql(text: str, most: int) -> str:
    on = lambda i: f"hex(encode(t)[{i + 1}:{i + 1}]) BETWEEN '80' AND 'BF'"
    return f"""SELECT *, CASE WHEN octet_length(encode(t)) <= {most} THEN t WHEN instr(head, chr(10)) > 0 AND length(head) - instr(reverse(head), chr(10)) >= {most // 2} THEN left(head, length(head) - instr(reverse(head), chr(10))) ELSE head END AS capped
FROM (SELECT *, decode(encode(t)[1:CASE WHEN octet_length(encode(t)) <= {most} THEN octet_length(encode(t)) WHEN NOT ({on(most)}) THEN {most} WHEN NOT ({on(most - 1)}) THEN {most - 1} WHEN NOT ({on(most - 2)}) THEN {most - 2} ELSE {most - 3} END]) AS head FROM ({text}) x) y"""


@query(f"SELECT doc_id, capped, CAST(octet_length(encode(capped)) AS BIGINT) AS n_bytes FROM ({cap_sql('SELECT doc_id, text AS t FROM documents', 501)}) z")
def byte_cap(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.byte_cap("text", 501).alias("capped")).withColumn("n_bytes", F.octet_length("capped").cast("long"))


@query(f"""WITH c AS ({cap_sql("SELECT doc_id, text || chr(10) || lang AS t FROM documents", 400)})
SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 400 THEN text_parts ELSE 1 END AS n_texts, CASE WHEN octet_length(encode(t)) <= 400 THEN t ELSE capped || chr(10) || chr(10) || '[output capped: ' || (octet_length(encode(t)) - octet_length(encode(capped))) || ' bytes dropped]' END AS shown
FROM (SELECT *, CAST(2 AS BIGINT) AS text_parts FROM c) d""")
def cap_tool_output(spark, sf_dir):
    """Two text parts and an image: the image stays, the texts are capped together."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array(part("text", F.col("text")), part("image", F.lit(None).cast("string")), part("text", F.col("lang"))).alias("content"))
    capped = G.cap_output("content", 400)
    n = F.size(F.filter("capped", lambda p: p["type"] == "text")).cast("long")
    return rows.select("doc_id", capped.alias("capped")).select("doc_id", n.alias("n_texts"), G.joined_text("capped").alias("shown"))


TIMEOUTS = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'Command timed out after ' || (event_id % 5000) || ' seconds' ELSE 'done in ' || event_id END AS line FROM events"


@query(f"SELECT event_id, coalesce(CAST(nullif(regexp_extract(line, 'Command timed out after ([0-9]+) seconds', 1), '') AS BIGINT), -1) AS seconds FROM ({TIMEOUTS}) t")
def detect_timeout(spark, sf_dir):
    return _timeouts(spark, sf_dir).select("event_id", F.coalesce("seconds", F.lit(-1)).alias("seconds"))


def _timeouts(spark, sf_dir):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("Command timed out after "), F.col("event_id") % 5000, F.lit(" seconds"))).otherwise(F.concat(F.lit("done in "), "event_id"))
    part = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    rows = read(spark, sf_dir, "events").select("event_id", F.array(part(F.lit("$ make")), part(line)).alias("content"))
    return rows.withColumn("seconds", G.detect_timeout("content"))


@query(f"SELECT event_id, CAST(least(3600, greatest(120, 2 * seconds)) AS BIGINT) AS suggested FROM (SELECT event_id, CAST(nullif(regexp_extract(line, 'Command timed out after ([0-9]+) seconds', 1), '') AS BIGINT) AS seconds FROM ({TIMEOUTS}) t) u WHERE seconds IS NOT NULL")
def suggest_timeout(spark, sf_dir):
    return _timeouts(spark, sf_dir).where("seconds is not null").select("event_id", G.suggest_timeout(F.col("seconds")).alias("suggested"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN -1 ELSE 60 END AS BIGINT) AS injected FROM events")
def bash_timeout(spark, sf_dir):
    asked = F.when(F.col("event_type") == "click", F.lit(5).cast("long"))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(G.default_timeout(asked), F.lit(-1)).alias("injected"))


@query("SELECT doc_id, repeat('█', n) || repeat('░', 20 - n) AS bar FROM (SELECT doc_id, CAST(least(20, greatest(0, floor((n_chars / 30.0) * 20 / 100 + 0.5))) AS INTEGER) AS n FROM documents) d")
def usage_bar(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.usage_bar(F.col("n_chars") / 30.0).alias("bar"))


@query("SELECT doc_id, left(sha256(text), 32) AS sha FROM documents")
def content_sha(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_sha("text").alias("sha"))


ANSI_SQL = X.ANSI.replace("'", "''")


@query(f"SELECT doc_id, regexp_replace(replace(replace(text, 'a', chr(27) || '[1;31ma'), 'o', chr(27) || ']0;t' || chr(7)), '{ANSI_SQL}', '', 'g') AS plain FROM documents")
def strip_ansi(spark, sf_dir):
    """Colour codes before each ``a``, a title in place of each ``o``."""
    coloured = F.replace(F.replace("text", F.lit("a"), F.lit("\x1b[1;31ma")), F.lit("o"), F.lit("\x1b]0;t\x07"))
    return docs(spark, sf_dir).select("doc_id", X.strip_ansi(coloured).alias("plain"))


_EVERY = rf"[{X.BLANKS}\p{{Cf}}]*"


def folded_sql(text: str) -> str:
    """Runs of white space as one glyph or space, the edges trimmed; all that folding does to Latin-1."""
    out = f"regexp_replace({text}, '{_EVERY}[{X.BREAKS}]{_EVERY}', '█', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '{_EVERY}[{X.BLANKS}]{_EVERY}', ' ', 'g'), '\p{{Cf}}+', '', 'g')"
    return f"regexp_replace({out}, '^[ █]+|[ █]+$', '', 'g')"


@query(f"SELECT doc_id, {folded_sql('text')} AS line FROM documents")
def collapse_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.collapse_blanks("text").alias("line"))


_LIGHT = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_MARKED = f"CASE WHEN list_contains([{_LIGHT}], lower(w)) THEN chr(14) || w || chr(15) ELSE w END"


@query(f"SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[{X.LETTERS}]+|[^{X.LETTERS}]+'), lambda w: {_MARKED}), 'string_agg', '') AS dimmed FROM documents WHERE text <> ''")
def dim_stopwords(spark, sf_dir):
    return docs(spark, sf_dir).where("text <> ''").select("doc_id", X.dim_stopwords("text").alias("dimmed"))


@query(f"SELECT doc_id, CAST(2 * length(text) - length(regexp_replace(text, '{X.WIDE}', '', 'g')) AS BIGINT) AS cells FROM documents")
def cell_width(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.cell_width("text").alias("cells"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace('[m' || doc_id % 100000 || '] ' || text, '^(?:<acp\s[^>]*>m[0-9]{5,}</acp>|\[m[0-9]+\])\s?\n?', ''), '^(?:<acp\s[^>]*>m[0-9]{5,}</acp>|\[m[0-9]+\])\s?\n?', '') AS text FROM documents")
def strip_ref_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.strip_ref_tag(X.strip_ref_tag(F.concat(F.lit("[m"), F.col("doc_id") % 100000, F.lit("] "), "text"))).alias("text"))


@query("SELECT s, CASE WHEN regexp_extract(trim(s), '^b?([0-9]+)$', 1) <> '' THEN 'b' || regexp_extract(trim(s), '^b?([0-9]+)$', 1) END AS block_id FROM (VALUES ('b3'), ('3'), (''), ('  '), ('xyz'), ('b'), ('abc123'), ('b-'), ('b12')) v(s)")
def parse_block_id(spark, sf_dir):
    rows = spark.createDataFrame([("b3",), ("3",), ("",), ("  ",), ("xyz",), ("b",), ("abc123",), ("b-",), ("b12",)], "s string")
    return rows.select("s", X.parse_block_id("s").alias("block_id"))


VERSIONS = [("1.2.3", "1.2.2"), ("v1.10.0", "1.9.9"), ("1.2", "1.2.0"), ("2.x.1", "2.0.0"), ("1.0.0", "1.0.0"), ("0.9.9", "1.0.0")]
_PART = "coalesce(try_cast(nullif(regexp_extract(coalesce(string_split(regexp_replace({v}, '^v', ''), '.')[{i}], ''), '^([0-9]+)', 1), '') AS BIGINT), 0)"
_NUMBERS = "[" + ", ".join(_PART.replace("{i}", str(i)) for i in (1, 2, 3)) + "]"


@query(f"SELECT a, b, {_NUMBERS.replace('{v}', 'a')} > {_NUMBERS.replace('{v}', 'b')} AS newer FROM (VALUES {', '.join(map(str, VERSIONS))}) v(a, b)")
def semver_newer(spark, sf_dir):
    return spark.createDataFrame(VERSIONS, "a string, b string").select("a", "b", X.semver_newer("a", "b").alias("newer"))


_LINE = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [info] [' || event_type || '] user=' || user_id || ' id=' || event_id"


@query(f"SELECT event_id, regexp_extract(line, '^(\\S+) ', 1) AS ts, regexp_extract(line, '^\\S+ \\[(\\w+)\\]', 1) AS level, regexp_extract(line, '\\] \\[([^\\]]*)\\]', 1) AS scope, regexp_extract(line, 'user=(\\S*)', 1) AS user FROM (SELECT event_id, {_LINE} AS line FROM events) l")
def parse_log(spark, sf_dir):
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("id"), F.col("event_id").cast("string"))
    line = X.log_line(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("info"), F.col("event_type"), fields)
    rows = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    p = X.log_fields("line")
    return rows.select("event_id", p["ts"].alias("ts"), p["level"].alias("level"), p["scope"].alias("scope"), p["fields"]["user"].alias("user"))


_SHAPES = "(VALUES " + ", ".join(f"('{s[0]}', {s[2]}, {s[3]}, {s[7]}, {s[6]}, {s[8]})" for s in L.SHAPES) + ") s(shape, cw, ch, rep, columns, size)"


@query(f"SELECT shape, CAST(cols AS BIGINT) AS cols, CAST(nrows AS BIGINT) AS n_rows, CAST(columns * cols * nrows AS BIGINT) AS capacity FROM (SELECT *, CASE WHEN columns = 2 THEN (size // cw - 3) // 2 ELSE size // cw END AS cols, size // (ch * rep) AS nrows FROM {_SHAPES}) t")
def shape_geometry(spark, sf_dir):
    g = L.geometry(F.col("cell_width"), F.col("cell_height"), F.col("line_repeat"), F.col("columns"), F.col("frame_size"))
    return L.shapes(spark).select("shape", g["cols"].alias("cols"), g["rows"].alias("n_rows"), g["capacity"].alias("capacity"))


_PRICE = "CAST(CASE WHEN family = 'google' THEN 1120 WHEN family = 'openai' THEN ceil(least(power(ceil(size / 32.0), 2), 10000) * 12 / 10) ELSE ceil(least(power(ceil(size / 28.0), 2), 4784) * 105 / 100) END AS BIGINT)"


@query(f"SELECT family, CAST(size AS BIGINT) AS size, {_PRICE} AS tokens FROM (VALUES ('google'), ('openai'), ('anthropic'), ('unknown')) f(family), (VALUES (1568), (1932), (2048), (2576)) s(size)")
def frame_price(spark, sf_dir):
    rows = spark.createDataFrame([(f, s) for f in ("google", "openai", "anthropic", "unknown") for s in (1568, 1932, 2048, 2576)], "family string, size long")
    return rows.select("family", "size", L.frame_price(F.col("family"), F.col("size")).alias("tokens"))


MODELS = [("anthropic-messages", "claude-opus-4.8"), ("anthropic-messages", "claude-3-haiku"), ("google-vertex", "gemini-2.5"), ("openai-responses", "gpt-5"), ("openai-completions", "GLM-4.6"), ("other", "kimi-k2"), ("bedrock-converse-stream", "mystery"), ("other", "llama"), ("google-generative-ai", None)]
_MODELS = "(VALUES " + ", ".join(f"('{a}', {'NULL' if m is None else repr(m)})" for a, m in MODELS) + ") m(api, id)"
_FAMILY = "CASE " + " ".join(f"WHEN api = '{a}' THEN '{f}'" for a, f in L.API_FAMILY) + " ELSE 'unknown' END"
_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(id, ''), '(?i){p}') THEN '{s}'" for p, s, _ in L.MODEL_SHAPES) + " WHEN family = 'anthropic' THEN '11on16-bw' ELSE '8on22-bw' END"
_SIZE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(id, ''), '(?i){p}') THEN {z or 1568}" for p, _, z in L.MODEL_SHAPES) + " ELSE 1568 END"


@query(f"SELECT api, id, family, shape, CAST(size AS BIGINT) AS frame_size, {_PRICE} AS frame_tokens FROM (SELECT *, {_SHAPE} AS shape, {_SIZE} AS size FROM (SELECT *, {_FAMILY} AS family FROM {_MODELS}) a) b")
def resolve_shape(spark, sf_dir):
    return L.resolve_shape(spark.createDataFrame(MODELS, "api string, id string"))


CAPACITY, COLS = 2000, 100


@query(f"SELECT doc_id, page, substring(text, page * {CAPACITY} + 1, {CAPACITY}) AS body FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {CAPACITY - 1}) // {CAPACITY})) AS page FROM documents) p")
def paginate_text(spark, sf_dir):
    """Narrow texts need no walk over characters."""
    pages = L.paginated_narrow(F.col("text"), CAPACITY)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(pages).alias("page", "body")).withColumn("page", F.col("page").cast("long"))


@query(f"SELECT doc_id, CAST(least(length(text), {CAPACITY}) AS BIGINT) AS shown FROM documents")
def page_chars(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.least(X.cell_width("text", wide=False), F.lit(CAPACITY)).cast("long").alias("shown"))


@query(f"SELECT doc_id, CAST(length(replace(line, '█', '')) AS BIGINT) AS graphic, CAST(0 AS BIGINT) AS lost, true AS safe FROM (SELECT doc_id, {folded_sql('text')} AS line FROM documents) d")
def renderability(spark, sf_dir):
    """Exact in SQL for Latin-1 texts, where nothing is lost."""
    r = docs(spark, sf_dir).select("doc_id", L.folded(F.col("text")).alias("r"))
    return r.select("doc_id", "r.graphic", "r.lost", (F.col("r.lost") <= 0.05 * F.col("r.graphic")).alias("safe"))


@query(f"SELECT doc_id, {folded_sql('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.folded(F.col("text"))["text"].alias("text"))


@query()
def wrap_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(L.wrapped(F.col("text"), 80)).alias("line", "text"))


@query()
def doc_pages(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(L.two_column_pages(F.col("text"), 96, 20)).alias("page", "text"))


@query()
def page_dim_state(spark, sf_dir):
    """Pages of a dimmed text, with the span that is open at a page's end reopened on the next."""
    pages = docs(spark, sf_dir).select("doc_id", L.two_column_pages(X.dim_stopwords("text"), 96, 20).alias("pages"))
    return pages.select("doc_id", F.posexplode("pages").alias("page", "text")).select("doc_id", "page", F.col("text").startswith(X.DIM_ON).alias("opens_dim"))


@query(f"""SELECT doc_id, CASE WHEN wide >= 8 AND wide >= 0.25 * length(replace(replace(line, '█', ''), ' ', '')) THEN 'silver16-bw' ELSE '8on22-bw' END AS shape
FROM (SELECT doc_id, doc_id % 60 AS wide, {folded_sql("left(text, 150) || repeat('漢', doc_id % 60)")} AS line FROM documents) d""")
def shape_for_text(spark, sf_dir):
    """Heads of texts with up to 59 ideographs after them."""
    text = F.concat(F.substring("text", 1, 150), F.expr("repeat('漢', cast(doc_id % 60 as int))"))
    return docs(spark, sf_dir).select("doc_id", L.shape_for(text, "8on22-bw").alias("shape"))
