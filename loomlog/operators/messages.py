"""Projection of session entries to canonical messages, and back.

Entries carry ``message`` and ``content`` as JSON text, since content is a string or an array of
typed parts; read as a variant, :func:`parse_content` makes both an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, strip_ref_tag, trimmed, with_ref_tag
from ..model import CONTENT, CORE_COLUMNS

def parse_content(value: Column, path: str = "$.content") -> Column:
    """A JSON string, or an array of typed parts, at ``path`` of a variant -> an array of parts."""
    whole = F.try_variant_get(value, path, "variant")
    null = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get(value, path, "string").alias("text"), null.alias("id"), null.alias("name"), null.alias("arguments")))

    def part(p: Column) -> Column:
        fields = [F.try_variant_get(p, f"$.{name}", "string").alias(name) for name in ("type", "text", "id", "name")]
        return F.struct(*fields, arguments_text(F.try_variant_get(p, "$.arguments", "variant")).alias("arguments"))

    parts = F.transform(F.try_variant_get(value, path, "array<variant>"), part)
    kind = F.coalesce(F.schema_of_variant(whole), F.lit("VOID"))
    return F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), parts).otherwise(F.array().cast(CONTENT))


def content_text(parts: Column) -> Column:
    """All text parts joined by line feeds, each without a leading reference tag."""
    texts = F.filter(parts, lambda p: p["type"].eqNullSafe("text") & p["text"].isNotNull())
    return F.array_join(F.transform(texts, lambda p: strip_ref_tag(p["text"])), "\n")


def tool_calls(parts: Column) -> Column:
    return F.filter(parts, lambda p: p["type"].eqNullSafe("toolCall") & (F.coalesce(p["name"], F.lit("")) != ""))


def arguments_text(arguments: Column) -> Column:
    """Arguments as text: nothing for nothing, a string as it is, else compact JSON."""
    text = F.when(F.schema_of_variant(arguments) == "STRING", arguments.cast("string")).otherwise(F.to_json(arguments))
    return F.when(arguments.isNull() | text.isin("null", "false", "0"), "").otherwise(text)


def fallback_text(command: Column, output: Column, summary: Column) -> Column:
    """What other roles say: ``$ command``, output and summary on lines."""
    some = lambda c: F.when(c != "", c)
    return trimmed(F.concat_ws("\n", F.when(command != "", F.concat(F.lit("$ "), command)), some(output), some(summary)))


def to_core(entries: DataFrame) -> DataFrame:
    """Entries (session_id, seq, type, id, content, message) -> canonical messages.

    A user or tool result gives one row, an assistant turn with calls a row for each call, without
    calls one if it isn't blank, other roles a user row if they say anything, a custom message a
    user row if it says anything; other entries none.
    """
    rows = entries.withColumn("v", F.when(F.col("type") == "custom_message", F.try_parse_json(F.concat(F.lit('{"content":'), "content", F.lit("}")))).otherwise(F.try_parse_json("message")))
    rows = rows.withColumn("parts", parse_content(F.col("v"))).withColumn("printed", content_text(parse_content(F.col("v"), "$.output")))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    rows = rows.select(*entries.columns, "parts", "printed", F.struct(*(field(n).alias(n) for n in ("role", "toolName", "toolCallId", "command", "summary"))).alias("m"))
    rows = rows.withColumn("said", content_text(F.col("parts"))).withColumn("calls", tool_calls(F.col("parts")))
    null = F.lit(None).cast("string")

    def row(id: Column, role: str, kind: str, name: Column, call: Column, text: Column) -> Column:
        return F.struct(id.alias("id"), F.lit(role).alias("role"), F.lit(kind).alias("content_type"), name.alias("tool_name"), call.alias("tool_call_id"), text.alias("text"))

    said, calls, id = F.col("said"), F.col("calls"), F.col("id")
    plain = lambda role, text: F.array(row(id, role, "text", null, null, text))
    many = F.size(calls) > 1

    def call_row(c: Column) -> Column:
        arguments = c["arguments"]
        alone = F.when((arguments != "") & (said != ""), F.concat(said, F.lit("\n"), arguments)).when(arguments != "", arguments).otherwise(said)
        split = F.when(arguments != "", arguments).otherwise(said)
        key = F.coalesce(c["id"], F.lit(""))
        return row(F.when(many, F.concat(id, F.lit("#"), key)).otherwise(id), "assistant", "tool-call", c["name"], key, F.when(many, split).otherwise(alone))

    other = F.when(said != "", said).otherwise(fallback_text(F.col("m.command"), F.col("printed"), F.col("m.summary")))
    none = F.filter(plain("user", said), lambda _: F.lit(False))
    role = F.col("m.role")
    out = (
        F.when((F.col("type") == "custom_message") & (said != ""), plain("user", said))
        .when(F.col("type") != "message", none)
        .when(role == "user", plain("user", said))
        .when(role == "toolResult", F.array(row(id, "tool", "tool-result", F.col("m.toolName"), F.col("m.toolCallId"), said)))
        .when((role == "assistant") & (F.size(calls) > 0), F.transform(calls, call_row))
        .when((role == "assistant") & (trimmed(said) != ""), plain("assistant", said))
        .when(role == "assistant", none)
        .when(other != "", plain("user", other))
        .otherwise(none)
    )
    out = rows.select("session_id", "seq", F.posexplode(out).alias("part", "c")).select("session_id", "c.*", "seq", "part")
    return out.select(*CORE_COLUMNS, "part")


def assign_refs(messages: DataFrame) -> DataFrame:
    """Number messages ``m00001``, ... within their session; numbers of more than five digits are whole."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "id")).cast("string")
    return messages.withColumn("ref", F.concat(F.lit("m"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)))


def tag(messages: DataFrame) -> DataFrame:
    """Put the reference after the text, in place of one before it; assistant messages stay as they are."""
    return messages.withColumn("tagged", F.when(F.col("role") == "assistant", F.col("text")).otherwise(with_ref_tag(strip_ref_tag(F.col("text")), F.col("ref"))))


def _text_part(text: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("id"), null.alias("name"), null.alias("arguments"))


_END = rf"[{BLANKS}\x{{feff}}]+\z"


def tag_parts(parts: Column, ref: Column, body: Column) -> Column:
    """Peel old tags and put the reference after the last text part, or add a part for it where there is
    none. With a ``body`` that says something and differs beyond trailing blanks, all text parts give way
    to one with it, after the parts that aren't text."""
    peeled = peel_parts(parts)
    last = F.array_max(F.transform(peeled, lambda p, i: F.when(p["type"].eqNullSafe("text"), i)))
    tagged = F.transform(peeled, lambda p, i: F.when(i.eqNullSafe(last), p.withField("text", with_ref_tag(p["text"], ref))).otherwise(p))
    tagged = F.when(last.isNull(), F.concat(peeled, F.array(_text_part(with_ref_tag(F.lit(""), ref))))).otherwise(tagged)
    same = F.regexp_replace(content_text(parts), _END, "") == F.regexp_replace(body, _END, "")
    return F.when(same | (F.coalesce(body, F.lit("")) == ""), tagged).otherwise(rebuild_parts(parts, with_ref_tag(body, ref, _END)))


def rebuild_parts(parts: Column, body: Column) -> Column:
    """Parts that aren't text, then one text part."""
    return F.concat(F.filter(parts, lambda p: ~p["type"].eqNullSafe("text")), F.array(_text_part(body)))


def peel_parts(parts: Column) -> Column:
    """Strip tags, and drop text parts that then say nothing."""
    peeled = F.transform(parts, lambda p: F.when(p["type"].eqNullSafe("text"), p.withField("text", strip_ref_tag(p["text"]))).otherwise(p))
    return F.filter(peeled, lambda p: ~(p["type"].eqNullSafe("text") & p["text"].eqNullSafe(F.lit(""))))


def base_id(id: Column) -> Column:
    """The entry that a row came from: rows of parallel calls are ``entry#call``."""
    return F.substring_index(id, "#", 1)


def rebuild(core: DataFrame, entries: DataFrame, hidden_calls: DataFrame | None = None) -> DataFrame:
    """Canonical rows back to entries, in order: summaries and hidden calls drop out, rows of
    parallel calls merge once, and of such an entry only the surviving calls' parts remain.

    The survivors of a split entry are those of ``core``, hidden or not.
    """
    live = core.where(~F.col("id").startswith("acp_summary_")).withColumn("base", base_id(F.col("id")))
    survivors = live.where(F.col("id").contains("#")).groupBy("session_id", "base").agg(F.collect_set("tool_call_id").alias("calls"))
    shown = live
    if hidden_calls is not None:
        hidden = hidden_calls.select("session_id", F.col("call_id").alias("h")).distinct()
        shown = shown.join(hidden.withColumnRenamed("h", "tool_call_id"), ["session_id", "tool_call_id"], "left_anti")
        shown = shown.join(hidden.withColumnRenamed("h", "id"), ["session_id", "id"], "left_anti")
    order = shown.groupBy("session_id", "base").agg(F.min("seq").alias("at"))
    out = entries.withColumn("base", F.col("id")).join(order, ["session_id", "base"]).join(survivors, ["session_id", "base"], "left")
    keep = lambda p: ~p["type"].eqNullSafe("toolCall") | F.col("calls").isNull() | F.array_contains("calls", F.coalesce(p["id"], F.lit("")))
    return out.select("session_id", "id", "at", F.filter("parts", keep).alias("parts"))
