"""Limits on tool output: byte caps over content arrays, timeouts and their notices.

Content is ``array<struct<type, text>>``; parts that aren't text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, byte_cap

DEFAULT_MAX_BYTES = 200_000
DEFAULT_TIMEOUT_S = 60
TIMED_OUT = r"Command timed out after ([0-9]+) seconds"


def joined_text(content: Column | str) -> Column:
    texts = F.transform(F.filter(_c(content), lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.array_join(texts, "\n")


def cap_notice(dropped: Column) -> Column:
    return F.concat(F.lit("\n\n[output capped: "), dropped.cast("string"), F.lit(" bytes dropped]"))


def cap_output(content: Column | str, most: int | None = None) -> Column:
    """Parts that aren't text first, then all texts joined and capped with a notice; content within
    the cap, or without text, stays as it is."""
    content = _c(content)
    most = DEFAULT_MAX_BYTES if most is None else most
    if most <= 0:
        return content
    text = joined_text(content)
    head = byte_cap(text, most)
    capped = F.concat(head, cap_notice(F.octet_length(text) - F.octet_length(head)))
    others = F.filter(content, lambda p: ~p["type"].eqNullSafe("text"))
    part = F.struct(F.lit("text").alias("type"), capped.alias("text"))
    return F.when(F.octet_length(text) > most, F.concat(others, F.array(part))).otherwise(content)


def detect_timeout(content: Column | str) -> Column:
    """Seconds of the first text part that reports a timeout, else null."""
    hits = F.filter(F.transform(F.filter(_c(content), lambda p: p["type"] == "text"), lambda p: F.regexp_extract(p["text"], TIMED_OUT, 1)), lambda s: s != "")
    return F.get(hits, F.lit(0)).cast("long")


def suggest_timeout(seconds: Column) -> Column:
    """Twice the time, from two minutes to an hour."""
    return F.least(F.lit(3600), F.greatest(F.lit(120), F.ceil(seconds * 2))).cast("long")


def timeout_notice(seconds: Column) -> Column:
    return F.concat(F.lit("\n\n[command stopped after "), seconds.cast("string"), F.lit(" s; give it timeout="), suggest_timeout(seconds).cast("string"), F.lit("]"))


def append_notice(content: Column | str, notice: Column) -> Column:
    """Append to the last text part, or as a new part where there is none."""
    content = _c(content)
    last = F.array_max(F.transform(content, lambda p, i: F.when(p["type"] == "text", i)))
    grown = F.transform(content, lambda p, i: F.when(i == last, F.struct(p["type"].alias("type"), F.concat(p["text"], notice).alias("text"))).otherwise(p))
    return F.when(last.isNull(), F.concat(content, F.array(F.struct(F.lit("text").alias("type"), notice.alias("text"))))).otherwise(grown)


def default_timeout(asked: Column, default: int | None = None) -> Column:
    """The timeout to inject: only where none is asked for and the default is positive."""
    default = DEFAULT_TIMEOUT_S if default is None else default
    return F.when(asked.isNull() & F.lit(default > 0), F.lit(default).cast("long"))
