"""Page layout: shapes, geometry, prices, folding, wrapping and pagination.

Grid arithmetic is column expressions. Folding and wrapping walk over characters with state, which
expressions can't say; they are Arrow UDFs over whole columns. Which characters a font can draw is
known to the renderer alone; here a ``drawable`` rule stands for it: wide characters are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .text import ANSI, DIM_OFF, DIM_ON, NEWLINE_GLYPH, STOPWORDS, WIDE_RANGES, collapse_blanks

SHAPE_SCHEMA = "shape string, font string, cell_width int, cell_height int, variant string, dim boolean, columns int, line_repeat int, frame_size int"
#: Shapes of pages (fixed values): name, font, cell width and height, variant, dims, columns, line repeat, frame size.
SHAPES = (
    ("8x8r-bw", "8x8", 8, 8, "bw", False, 1, 2, 1568),
    ("8x8r-sent", "8x8", 8, 8, "sent", False, 1, 2, 1568),
    ("8x8u-bw", "8x8", 8, 8, "bw", False, 1, 1, 1568),
    ("8x8u-sent", "8x8", 8, 8, "sent", False, 1, 1, 1568),
    ("6x6u-bw", "8x8", 6, 6, "bw", False, 1, 1, 1568),
    ("6x6u-sent", "8x8", 6, 6, "sent", False, 1, 1, 1568),
    ("5x8-bw", "5x8", 5, 8, "bw", False, 1, 1, 2576),
    ("5x8-sent", "5x8", 5, 8, "sent", False, 1, 1, 2576),
    ("6x12-dim", "6x12", 6, 12, "bw", True, 1, 1, 1568),
    ("8x13-bw", "8x13", 8, 13, "bw", False, 1, 1, 1568),
    ("8on16-bw", "8x13", 8, 16, "bw", False, 1, 1, 1568),
    ("8on22-bw", "8x13", 8, 22, "bw", False, 1, 1, 1568),
    ("11on16-bw", "8x13", 11, 16, "bw", False, 1, 1, 1568),
    ("silver16-bw", "silver", 16, 16, "bw", False, 1, 1, 1568),
    ("doc-8on16-bw", "8x13", 8, 16, "bw", False, 2, 1, 1568),
    ("doc-8on16-sent", "8x13", 8, 16, "sent", False, 2, 1, 1568),
    ("doc-8on16-sent-dim", "8x13", 8, 16, "sent", True, 2, 1, 1568),
)
#: Model id patterns in order, the first that matches wins (fixed values): pattern, shape, frame size.
MODEL_SHAPES = (
    ("claude.*(fable|mythos)", "11on16-bw", 1932),
    ("claude-?opus-?4[.-][7-9]", "11on16-bw", 1932),
    ("claude", "11on16-bw", None),
    ("gemini", "8on22-bw", 2048),
    ("gpt|codex", "8on22-bw", None),
    ("kimi", "8on22-bw", None),
    ("glm", "8on16-bw", None),
)
#: Wire APIs and who bills for them (fixed values).
API_FAMILY = (
    ("anthropic-messages", "anthropic"),
    ("bedrock-converse-stream", "anthropic"),
    ("openai-completions", "openai"),
    ("openai-responses", "openai"),
    ("openai-codex-responses", "openai"),
    ("azure-openai-responses", "openai"),
    ("google-generative-ai", "google"),
    ("google-gemini-cli", "google"),
    ("google-vertex", "google"),
)
FAMILY_SHAPE = {"anthropic": "11on16-bw", "google": "8on22-bw", "openai": "8on22-bw", "unknown": "8on22-bw"}
GUTTER = 3
#: Characters and what they print as (fixed values).
FOLDS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "′": "'", "″": '"', "‵": "'", "‶": '"', "‹": "<", "›": ">",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁄": "/",
    "․": ".", "‥": "..", "…": "...", "⋯": "...",
    "•": "*", "‣": "*", "⁃": "-", "∙": "*", "●": "*", "■": "*", "▪": "*",
    "←": "<-", "↑": "^", "→": "->", "↓": "v", "↔": "<->", "⇐": "<=", "⇒": "=>", "⇔": "<=>",
    "✓": "v", "✔": "v", "✗": "x", "✘": "x",
}
EMOJI = {
    "✅": "[OK]", "☑": "[OK]", "✔": "[OK]", "❌": "[FAIL]", "❎": "[FAIL]", "✖": "[FAIL]",
    "⚠": "[WARN]", "\U0001f6a8": "[ALERT]", "ℹ": "[INFO]", "\U0001f41b": "[BUG]", "\U0001f4a5": "[CRASH]", "\U0001f525": "[HOT]",
    "\U0001f512": "[LOCK]", "\U0001f513": "[UNLOCK]", "\U0001f4c1": "[DIR]", "\U0001f4c2": "[DIR]", "\U0001f4c4": "[FILE]",
    "\U0001f4dd": "[NOTE]", "\U0001f9ea": "[TEST]", "⏳": "[WAIT]", "⌛": "[WAIT]", "\U0001f680": "[RUN]",
}
_BLANK = "\t\n\x0b\f\r \xa0  -     　"


def shapes(spark: SparkSession) -> DataFrame:
    """The fixed list of shapes; small enough to broadcast."""
    return spark.createDataFrame(SHAPES, SHAPE_SCHEMA)


def geometry(cell_width: Column, cell_height: Column, line_repeat: Column, columns: Column, size: Column) -> dict[str, Column]:
    grid = F.floor(size / cell_width)
    rows = F.floor(F.floor(size * 1000 / cell_height / line_repeat) / 1000).cast("long")
    two = columns == 2
    cols = F.when(two, F.floor((grid - GUTTER) / 2)).otherwise(grid).cast("long")
    return {"cols": cols, "rows": rows, "capacity": (F.when(two, 2).otherwise(1) * cols * rows).cast("long")}


def frame_price(family: Column, size: Column) -> Column:
    """Tokens that a frame costs."""
    patches = lambda cell, most: F.least(F.pow(F.ceil(size / cell), 2).cast("long"), F.lit(most))
    openai = F.ceil(patches(32, 10_000) * 12 / 10)
    other = F.ceil(patches(28, 4784) * 105 / 100)
    return F.when(family == "google", 1120).when(family == "openai", openai).otherwise(other).cast("long")


def billing_family(api: Column) -> Column:
    out = F.lit("unknown")
    for name, family in API_FAMILY:
        out = F.when(api == name, family).otherwise(out)
    return out


def resolve_shape(models: DataFrame) -> DataFrame:
    """``models`` (api, id) -> with family, shape, frame_size and frame_tokens: the first model
    pattern that matches, else the family's shape."""
    family = billing_family(F.col("api"))
    shape, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for pattern, name, frame in reversed(MODEL_SHAPES):
        hit = F.coalesce(F.col("id"), F.lit("")).rlike(f"(?i){pattern}")
        shape, size = F.when(hit, name).otherwise(shape), F.when(hit, F.lit(frame).cast("int")).otherwise(size)
    fallback = F.lit(FAMILY_SHAPE["unknown"])
    for name, usual in FAMILY_SHAPE.items():
        fallback = F.when(F.col("family") == name, usual).otherwise(fallback)
    out = models.withColumn("family", family).withColumn("shape", F.coalesce(shape, fallback)).withColumn("own_size", size)
    base = F.broadcast(shapes(models.sparkSession).select("shape", F.col("frame_size").alias("base_size")))
    out = out.join(base, "shape").withColumn("frame_size", F.coalesce("own_size", "base_size"))
    return out.select(*models.columns, "family", "shape", F.col("frame_size").cast("long").alias("frame_size"), frame_price(F.col("family"), F.col("frame_size")).alias("frame_tokens"))


def is_wide(ch: str) -> bool:
    cp = ord(ch)
    return cp >= 0x1100 and any(a <= cp <= b for a, b in WIDE_RANGES)


def cells(ch: str, wide: bool = True) -> int:
    return 0 if ch in (DIM_ON, DIM_OFF) else 2 if wide and is_wide(ch) else 1


def _pictograph(ch: str) -> bool:
    cp = ord(ch)
    return 0x1F000 <= cp <= 0x1FAFF or 0x2600 <= cp <= 0x27BF or ch in EMOJI


def _plain(ch: str) -> bool:
    return 0x20 <= ord(ch) < 0x7F or 0xA0 <= ord(ch) <= 0xFF


def _decomposed(ch: str) -> str | None:
    parts = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.category(c).startswith("M"))
    if parts == ch:
        return None
    out = [c if _plain(c) else FOLDS.get(c) for c in parts]
    return None if None in out else "".join(out)


_RUN = re.compile(f"(?:[{_BLANK}]|[\xad؀-؅؜۝܏᠎​-‏‪-‮⁠-⁯﻿￹-￻])+")
_ESCAPES = re.compile(ANSI)
_SIMPLE = re.compile("[\x20-\x7e\n\xa1-\xac\xae-\xff]*")
_LETTERS = re.compile("[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LIGHT = frozenset(STOPWORDS)
_EDGES = re.compile(f"^[ {NEWLINE_GLYPH}]+|[ {NEWLINE_GLYPH}]+$")


def _one_run(m: re.Match) -> str:
    run = m.group()
    if re.search("[\n\r  ]", run):
        return NEWLINE_GLYPH
    return " " if re.search(f"[{_BLANK}]", run) else ""


def fold(text: str, drawable: Callable[[str], bool] = is_wide) -> tuple[str, int, int]:
    """(printable text, graphic characters, of these those that only print as ``?``).

    Latin-1 passes; then emoji, symbols, box drawing, what the font can draw, what decomposes into
    Latin-1, and ``?`` for the rest; marks and controls vanish.
    """
    if _SIMPLE.fullmatch(text):
        # line feeds, spaces and Latin-1 alone: most texts
        text = re.sub("  +", " ", re.sub(" *\n[ \n]*", NEWLINE_GLYPH, text)).strip(f" {NEWLINE_GLYPH}")
        return text, len(text) - text.count(NEWLINE_GLYPH), 0
    text = _EDGES.sub("", _RUN.sub(_one_run, _ESCAPES.sub("", text)))
    out: list[str] = []
    graphic = lost = 0
    for ch in text:
        if _plain(ch):
            shown: str | None = ch
        elif ch in (DIM_ON, DIM_OFF, NEWLINE_GLYPH):
            out.append(ch)
            continue
        elif ch in EMOJI:
            shown = EMOJI[ch]
        elif ch in FOLDS:
            shown = FOLDS[ch]
        elif "─" <= ch <= "╿":
            shown = {"│": "|", "┃": "|", "─": "-", "━": "-"}.get(ch, "+")
        elif not _pictograph(ch) and drawable(ch):
            shown = ch
        elif (shown := _decomposed(ch)) is None:
            if _pictograph(ch) or unicodedata.category(ch) in ("Cc", "Mn", "Me", "Cs"):
                continue
            shown = "?"
            lost += 1
        graphic += 1
        out.append(shown)
    return _EDGES.sub("", re.sub(" +", " ", "".join(out))), graphic, lost


def wide_share(text: str) -> tuple[int, int]:
    """(graphic characters, wide ones), for choosing a font for CJK text."""
    graphic = wide = 0
    for ch in _EDGES.sub("", _RUN.sub(_one_run, _ESCAPES.sub("", text))):
        if ch in (" ", DIM_ON, DIM_OFF, NEWLINE_GLYPH) or unicodedata.category(ch) in ("Cc", "Mn", "Me", "Cs"):
            continue
        graphic += 1
        wide += is_wide(ch)
    return graphic, wide


def slice_cells(text: str, width: int, wide: bool = True) -> str:
    """The longest prefix within ``width`` cells, but one visible character at least."""
    used, placed = 0, False
    for i, ch in enumerate(text):
        w = cells(ch, wide)
        if placed and used + w > width:
            return text[:i]
        used += w
        placed = placed or w > 0
    return text


def wrap(text: str, width: int, wide: bool = True) -> list[str]:
    """Greedy word wrap; words wider than a line break hard."""
    lines: list[str] = []
    line, used = "", 0
    for word in text.split():
        size = sum(cells(c, wide) for c in word)
        while size > width:
            if line:
                lines.append(line)
                line, used = "", 0
            head = slice_cells(word, width, wide)
            lines.append(head)
            word = word[len(head) :]
            size = sum(cells(c, wide) for c in word)
        if line and used + 1 + size <= width:
            line, used = f"{line} {word}", used + 1 + size
        else:
            if line:
                lines.append(line)
            line, used = word, size
    return [*lines, line] if line else lines


def paginate(text: str, capacity: int, cols: int, wide: bool = True) -> list[str]:
    """Pages of ``capacity`` cells; a wide character never straddles the end of a line."""
    pages, start, cell, started = [], 0, 0, False
    for i, ch in enumerate(text):
        w = cells(ch, wide)
        if not w:
            continue
        at = cell + (w == 2 and cols >= 2 and cell % cols == cols - 1)
        if started and at + w > capacity:
            pages.append(text[start:i])
            start, at = i, 0
        cell, started = at + w, True
    return [*pages, text[start:]] if started else pages


def shown_chars(text: str, capacity: int, cols: int, wide: bool = True) -> int:
    """Characters of a page that are drawn before its cells are used up."""
    cell = count = 0
    for ch in text:
        w = cells(ch, wide)
        if not w:
            continue
        at = cell + (w == 2 and cols >= 2 and cell % cols == cols - 1)
        if at + w > capacity:
            break
        cell, count = at + w, count + 1
    return count


def doc_pages(text: str, cols: int, rows: int, wide: bool = True) -> list[str]:
    """Two columns of ``rows`` wrapped lines a page."""
    lines = wrap(text, cols, wide)
    return ["\n".join(lines[i : i + 2 * rows]) for i in range(0, len(lines), 2 * rows)]


def carry_dim(pages: list[str]) -> list[str]:
    """Reopen on each page the dim span that the page before left open."""
    out, opened = [], False
    for page in pages:
        page = DIM_ON + page if opened else page
        opened = page.rfind(DIM_ON) > page.rfind(DIM_OFF)
        out.append(page)
    return out


def draws_wide(font: str) -> Callable[[str], bool]:
    """What a font draws beyond Latin-1, where the renderer's tables aren't there: wide characters."""
    return is_wide


def choose_shape(text: str, ideal: str, fixed: bool = False, drawable: Callable[[str], Callable[[str], bool]] = draws_wide) -> str:
    """The silver font where the ideal one loses over a twentieth of the characters and silver doesn't,
    and for text that is mostly wide, if silver can draw it; ``drawable`` gives a font's rule."""
    if fixed:
        return ideal
    safe = lambda font: (f := fold(text, drawable(font)))[2] <= 0.05 * f[1]
    font = next(s[1] for s in SHAPES if s[0] == ideal)
    if not safe(font):
        return "silver16-bw" if safe("silver") else ideal
    chars, wide = wide_share(text)
    heavy = font != "silver" and wide >= 8 and wide >= 0.25 * chars
    return "silver16-bw" if heavy and safe("silver") else ideal


@dataclass(frozen=True)
class Grid:
    """What pages of a shape look like; silver's cells are as wide as any character."""

    cols: int
    rows: int
    columns: int = 1
    dim: bool = False
    wide: bool = True
    font: str = ""

    @property
    def capacity(self) -> int:
        return self.columns * self.cols * self.rows


def grid_of(shape: str, size: int | None = None) -> Grid:
    """:func:`geometry` of one shape."""
    _, font, width, height, _, dim, columns, repeat, own = next(s for s in SHAPES if s[0] == shape)
    size = size or own
    across = size // width
    return Grid((across - GUTTER) // 2 if columns == 2 else across, size // (height * repeat), columns, dim, font != "silver", font)


def page_text(text: str, grid: Grid, drawable: Callable[[str], Callable[[str], bool]] = draws_wide) -> list[str]:
    """Fold a text and cut it into pages: columns of wrapped lines, with dim spans carried on, or cells."""
    text = fold(text, drawable(grid.font))[0]
    pages = carry_dim(doc_pages(text, grid.cols, grid.rows, grid.wide)) if grid.columns == 2 else paginate(text, grid.capacity, grid.cols, grid.wide)
    return [dim_words(p) for p in pages] if grid.dim else pages


def dim_words(text: str) -> str:
    """:func:`text.dim_stopwords` of one text."""
    out, dim = [], False
    for part in re.split(f"([{DIM_ON}{DIM_OFF}])", text):
        if part in (DIM_ON, DIM_OFF):
            dim = part == DIM_ON
        elif not dim:
            part = _LETTERS.sub(lambda m: f"{DIM_ON}{m[0]}{DIM_OFF}" if m[0].lower() in _LIGHT else m[0], part)
        out.append(part)
    return "".join(out)


def page_array(text: Column, grid: Grid) -> Column:
    """:func:`page_text` as a column. Texts of letters that any font has, on pages of plain cells, stay
    in the JVM; the others go through Python."""
    if grid.columns == 2 or grid.dim:
        return _column("array<string>", lambda t: page_text(t, grid))(text)
    odd = text.rlike(r"[^\x20-\x7e\n\xa1-\xac\xae-\xff]")
    others = _column("array<string>", lambda t: page_text(t, grid))(F.when(odd, text))
    return F.when(odd, others).otherwise(paginated_narrow(collapse_blanks(text), grid.capacity))


def _column(kind: str, function: Callable[[str], object]) -> Callable:
    ship_package(SparkSession.active())

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else function(t) for t in texts])

    return run


def folded(text: Column) -> Column:
    """struct<text, graphic, lost> of :func:`fold`."""
    ship_package(SparkSession.active())

    @F.pandas_udf("text string, graphic long, lost long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([fold(t or "") for t in texts], columns=["text", "graphic", "lost"])

    return run(text)


def wrapped(text: Column, width: int, wide: bool = True) -> Column:
    return _column("array<string>", lambda t: wrap(t, width, wide))(text)


def paginated(text: Column, capacity: int, cols: int, wide: bool = True) -> Column:
    return _column("array<string>", lambda t: paginate(t, capacity, cols, wide))(text)


def paginated_narrow(text: Column, capacity: int) -> Column:
    """Pages of a text without wide characters or markers, in the JVM."""
    n = F.ceil(F.length(text) / capacity).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * capacity + 1, F.lit(capacity)))
    return F.when(n > 0, pages).otherwise(F.array().cast("array<string>"))


def two_column_pages(text: Column, cols: int, rows: int) -> Column:
    return _column("array<string>", lambda t: carry_dim(doc_pages(t, cols, rows)))(text)


def shape_for(text: Column, ideal: str) -> Column:
    return _column("string", lambda t: choose_shape(t, ideal))(text)

