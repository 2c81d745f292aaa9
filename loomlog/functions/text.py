"""Scalar text functions as Column expressions; all stay in the JVM.

Lengths count code points. White space is listed explicitly, since ``\\s`` differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs, kana and Hangul count as one token each.
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
#: Characters two cells wide, by code point range (fixed values).
WIDE_RANGES = (
    (0x1100, 0x115F), (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
    (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD),
)
WIDE = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in WIDE_RANGES) + "]"
DIM_ON, DIM_OFF = "\x0e", "\x0f"
NEWLINE_GLYPH = "█"
#: White space that isn't a format character, and line breaks among it.
BLANKS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAKS = r"\n\r\x{2028}\x{2029}"
#: White space that trimming takes off, as characters (fixed values).
TRIMMED = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Terminal escapes (fixed values).
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x1b\\|\x07)|\x1b[@-Z\\-_]"
#: Forms of a reference before a text (fixed values).
REF_TAG = r"^(?:<acp\s[^>]*>m[0-9]{5,}</acp>|\[m[0-9]+\])\s?\n?"
#: Words of little weight (fixed values).
STOPWORDS = (
    "the a an and or of to in on at as is are was were be been by for with that "
    "this it its from had has have not but he she his her they their them which also "
    "who whom when where while will would could should there then than into over under about after "
    "before between during each such these those some most more other only same so"
).split()
LETTERS = r"a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ceil_div(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / d).cast("long")


def token_estimate(text: Column | str) -> Column:
    """One token a CJK character, one for four others, rounded up."""
    text = F.coalesce(_c(text), F.lit(""))
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return (cjk + _ceil_div(F.length(text) - cjk, 4)).cast("long")


def quarter_tokens(text: Column | str) -> Column:
    """A token for four characters, rounded up."""
    return _ceil_div(F.length(F.coalesce(_c(text), F.lit(""))), 4)


def truncate_head_tail(text: Column | str, most: int = 2000, head: float = 0.6) -> Column:
    """Keep the head and the tail of a long text and say how much is left out between."""
    text = _c(text)
    first = int(most * min(max(head, 0), 1) + 0.5)
    middle = F.concat(F.lit(" […"), (F.length(text) - most).cast("string"), F.lit("ch elided…] "))
    tail = F.right(text, F.lit(most - first)) if most > first else F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, first), middle, tail))


def truncate_ellipsis(text: Column | str, most: int) -> Column:
    text = _c(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def one_line(text: Column | str, most: int = 48) -> Column:
    """A preview on one line."""
    return truncate_ellipsis(trimmed(F.regexp_replace(_c(text), r"[\r\n]+", " ")), most)


def head_preview(text: Column | str, most: int = 600) -> Column:
    text = _c(text)
    notice = F.concat(F.lit("\n[+"), (F.length(text) - most).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), notice))


def byte_cap(text: Column | str, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, never a part of a character; cut at the last line feed if
    that is no less than half the bound away (counted in characters)."""
    text = _c(text)
    data = text.cast("binary")
    goes_on = lambda i: F.hex(F.substring(data, i + 1, 1)).between("80", "BF")
    end = F.when(~goes_on(most), most).when(~goes_on(most - 1), most - 1).when(~goes_on(most - 2), most - 2).otherwise(most - 3)
    head = F.substr(data, F.lit(1), end).cast("string")
    back = F.locate("\n", F.reverse(head))
    line = F.length(head) - back
    cut = F.when((back > 0) & (line >= most // 2), F.left(head, line)).otherwise(head)
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def strip_ansi(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), ANSI, "")


def collapse_blanks(text: Column | str) -> Column:
    """Runs of white space and format characters become one glyph if they hold a line break, a space
    if they hold white space, nothing otherwise; the edges are trimmed."""
    text = _c(text)
    every = rf"[{BLANKS}\p{{Cf}}]*+"
    out = F.regexp_replace(text, rf"[{BLANKS}\p{{Cf}}&&[^{BREAKS}]]*+[{BREAKS}]{every}", NEWLINE_GLYPH)
    out = F.regexp_replace(out, rf"\p{{Cf}}*+[{BLANKS}]{every}", " ")
    out = F.regexp_replace(out, r"\p{Cf}+", "")
    # most texts have spaces and line feeds only, which needs no look at every character's category
    simple = F.regexp_replace(F.regexp_replace(text, r" *+\n[ \n]*+", NEWLINE_GLYPH), r" {2,}+", " ")
    out = F.when(text.rlike(r"[^\x20-\x7e\n\xa1-\xac\xae-\x{24f}]"), out).otherwise(simple)
    return F.btrim(out, F.lit(f" {NEWLINE_GLYPH}"))


def cell_width(text: Column | str, wide: bool = True) -> Column:
    """Cells of a text on a grid; dim markers take none."""
    text = F.regexp_replace(_c(text), r"[\x0e\x0f]", "")
    if not wide:
        return F.length(text).cast("long")
    return (2 * F.length(text) - F.length(F.regexp_replace(text, WIDE, ""))).cast("long")


def strip_ref_tag(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), REF_TAG, "")


def ref_tag(ref: Column) -> Column:
    return F.concat(F.lit("["), ref, F.lit("]"))


def with_ref_tag(body: Column, ref: Column, end: str = r"\n+\z") -> Column:
    """A text, without what matches ``end``, then a blank line and the reference; the reference alone for an empty one."""
    body = F.regexp_replace(body, end, "")
    return F.when(body == "", ref_tag(ref)).otherwise(F.concat(body, F.lit("\n\n"), ref_tag(ref)))


def trimmed(text: Column | str) -> Column:
    """Without white space at both ends, line feeds and tabs too."""
    return F.btrim(_c(text), F.lit(TRIMMED))


def content_sha(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 32)


def dim_stopwords(text: Column | str) -> Column:
    """Wrap words of little weight in dim markers, outside spans that are dim already."""
    words = rf"(?i)(?<![{LETTERS}])({'|'.join(STOPWORDS)})(?![{LETTERS}])"
    parts = F.regexp_extract_all(_c(text), F.lit(r"[\x0e\x0f]|[^\x0e\x0f]+"), 0)
    start = F.struct(F.lit(False).alias("dim"), F.lit("").alias("out"))

    def step(state: Column, part: Column) -> Column:
        marked = F.when(part.isin(DIM_ON, DIM_OFF) | state["dim"], part).otherwise(F.regexp_replace(part, words, f"{DIM_ON}$1{DIM_OFF}"))
        dim = F.when(part == DIM_ON, True).when(part == DIM_OFF, False).otherwise(state["dim"])
        return F.struct(dim.alias("dim"), F.concat(state["out"], marked).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def parse_block_id(text: Column | str) -> Column:
    """``b3`` and ``3`` give ``b3``, anything else null."""
    number = F.regexp_extract(trimmed(_c(text)), r"^b?([0-9]+)\z", 1)
    return F.when(number != "", F.concat(F.lit("b"), number))


def semver_newer(latest: Column | str, current: Column | str) -> Column:
    """Whether one version comes after another, by three numbers; what is no number counts as 0."""

    def numbers(v: Column) -> Column:
        parts = F.split(F.regexp_replace(v, "^v", ""), r"\.")
        part = lambda i: F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^([0-9]+)", 1)
        return F.struct(*(F.when(part(i) == "", 0).otherwise(part(i).cast("long")).alias(f"n{i}") for i in range(3)))

    return numbers(_c(latest)) > numbers(_c(current))


def usage_bar(percent: Column, cells: int = 20) -> Column:
    """A bar of ``cells`` cells, filled as far as the percentage."""
    filled = F.least(F.lit(cells), F.greatest(F.lit(0), F.floor(percent * cells / 100 + 0.5))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled))


def log_fields(line: Column | str) -> dict[str, Column]:
    """``<timestamp> [level] [scope] k=v k=v`` -> its parts; fields as a map."""
    line = _c(line)
    head = r"^(\S+) \[(\w+)\] \[([^\]]*)\] ?(.*)$"
    body = F.regexp_extract(line, head, 4)
    return {
        "ts": F.regexp_extract(line, head, 1),
        "level": F.regexp_extract(line, head, 2),
        "scope": F.regexp_extract(line, head, 3),
        "fields": F.map_from_entries(
            F.transform(F.regexp_extract_all(body, F.lit(r"(\w+)=(\S*)"), 0), lambda kv: F.struct(F.substring_index(kv, "=", 1), F.substr(kv, F.length(F.substring_index(kv, "=", 1)) + 2)))
        ),
    }


def log_line(ts: Column, level: Column, scope: Column, fields: Column) -> Column:
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(ts, F.lit(" ["), level, F.lit("] ["), scope, F.lit("] "), F.array_join(pairs, " "))


def size_text(n: Column) -> Column:
    """Display only: 1.2M, 3.4K, 56."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def divider(width: int = 40) -> Column:
    return F.repeat(F.lit("─"), F.lit(width))
