"""Markdown and HTML: blocks, inlines, tables, contents, sanitising.

Lines are walked where their document lies, map-only: code fences and tables depend on the lines before and after, and
windows over them would shuffle every line of the corpus.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.scalar import slugify
from folioframe.plans.batches import made_rows

_SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", re.ASCII)
_ORDERED = re.compile(r"\d\. ", re.ASCII)


class Line(NamedTuple):
    """A line with its place; fenced: between code fences; fence: is one; tab: the line that its table begins at, if it is in one."""

    line_no: int
    line: str
    fenced: bool
    fence: bool
    fence_no: int
    tab: int | None = None
    separates: bool = False


def _lines(text: str | None) -> list[Line]:
    """The lines of a text.

    A table starts at a line with a leading bar whose next non-blank line is a separator, and ends before the first
    line that is blank or has no bar; blank lines are let through between header and separator only.
    """
    if text is None:
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    following: list[int | None] = [None] * len(lines)
    for i in range(len(lines) - 2, -1, -1):
        following[i] = i + 1 if lines[i + 1].strip(" ") else following[i + 1]
    found, fences, tab, separator, latest = [], 0, None, -1, -1
    for i, line in enumerate(lines):
        fence = line.startswith("```")
        fences += fence
        fenced = fences % 2 == 1 and not fence
        plain, after = not fenced and not fence, following[i]
        starts = plain and line.strip(" ").startswith("|") and after is not None and "-" in lines[after] and bool(_SEPARATOR.search(lines[after]))
        if starts:
            latest = max(latest, after)
        if not ((plain and "|" in line) or i < latest):
            tab = None
        elif starts and tab is None:
            tab, separator = i, after
        found.append(Line(i, line, fenced, fence, (fences + 1) // 2, tab, tab is not None and i == separator))
    return found


def _blocks(text: str | None) -> Iterator[tuple[str, int | None, str | None, str]]:
    """(kind, level, language, text) of the blocks of a text, in order."""

    def part(line: Line) -> tuple:
        if line.fenced or line.fence:
            return "code", line.fence_no
        return ("table", line.tab) if line.tab is not None else ("line", line.line_no)

    for (kind, _), run in itertools.groupby(_lines(text), part):
        own = list(run)
        line = own[0].line
        if kind == "code":
            yield "code", None, line[3:].strip(" "), "\n".join(x.line for x in own if x.fenced)
        elif kind == "table":
            yield "table", None, None, "\n".join(x.line.strip(" ") for x in own if not x.separates and x.line.strip(" "))
        elif line.strip(" "):
            hashes = len(line) - len(line.lstrip("#"))
            if hashes and line[hashes : hashes + 1] == " ":
                yield "heading", min(hashes, 6), None, line[hashes + 1 :]
            elif line[:2] in ("- ", "* ", "> "):
                yield "quote" if line[0] == ">" else "bullet", None, None, line[2:]
            elif _ORDERED.match(line):
                yield "ordered", None, None, line[3:]
            else:
                yield "paragraph", None, None, line


def _walk(df: DataFrame, id_col: str, text_col: str, rows: Callable, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """doc_id and the tuples that rows makes of each text."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_rows(batches, rows, ["doc_id", *names], kinds)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(walk, f"doc_id {kind}, {schema}")


def _marked_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
    schema = "line_no int, line string, fenced boolean, fence boolean, fence_no int, tab int, separates boolean"
    return _walk(df, id_col, text_col, _lines, list(Line._fields), kinds, schema)


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, fenced, fence, fence_no): lines with their place; fenced: between code fences; fence: is one."""
    return _marked_lines(df, id_col, text_col).drop("tab", "separates")


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, block_idx, block_type, level, lang, text): code fences, headings, items, quotes, tables, paragraphs, in order."""
    numbered = lambda text: ((i, *b) for i, b in enumerate(_blocks(text)))
    names, kinds = ["block_idx", "block_type", "level", "lang", "text"], [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return _walk(df, id_col, text_col, numbered, names, kinds, "block_idx int, block_type string, level int, lang string, text string")


_INLINE = r"\*\*.+?\*\*|\*[^*]+?\*|`[^`]+`|!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)"


def markdown_inlines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, run_idx, kind, content, url) of blocks' texts: bold, italic, code, image, link and plain text."""
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s){_INLINE}|(?:(?!{_INLINE}).)+"), 0)
    runs = blocks.where("block_type <> 'code' and text <> ''").select("doc_id", "block_idx", F.posexplode(pieces).alias("run_idx", "p"))
    p = F.col("p")
    inner = lambda n: F.substring(p, F.lit(n + 1), F.length(p) - 2 * n)
    kind = F.when(p.rlike(r"(?s)^\*\*.+\*\*$"), "bold").when(p.rlike(r"(?s)^\*[^*]+\*$"), "italic").when(p.rlike("(?s)^`[^`]+`$"), "code").when(p.rlike(r"(?s)^!\[[^\]]*\]\([^)]*\)$"), "image").when(p.rlike(r"(?s)^\[[^\]]*\]\([^)]*\)$"), "link").otherwise("text")
    label, url = F.regexp_extract(p, r"(?s)^!?\[([^\]]*)\]", 1), F.regexp_extract(p, r"(?s)\]\(([^)]*)\)$", 1)
    content = F.when(kind == "bold", inner(2)).when(kind.isin("italic", "code"), inner(1)).when(kind.isin("image", "link"), label).otherwise(p)
    return runs.select("doc_id", "block_idx", "run_idx", kind.alias("kind"), content.alias("content"), F.when(kind.isin("image", "link"), url).alias("url"))


def markdown_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, table_line, row, col, value, is_header) of tables; the separator row isn't one."""

    def rows(text: str | None) -> Iterator[tuple[int, int, str, bool]]:
        inside = (x for x in _lines(text) if x.tab is not None and not x.separates and x.line.strip(" "))
        for tab, own in itertools.groupby(inside, lambda x: x.tab):
            for i, x in enumerate(own):
                yield tab, i, x.line.strip(" ").removeprefix("|").removesuffix("|"), x.line_no == tab

    names, kinds = ["table_line", "row", "line", "is_header"], [pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    found = _walk(df, id_col, text_col, rows, names, kinds, "table_line int, row int, line string, is_header boolean")
    cells = found.select("doc_id", "table_line", "row", F.posexplode(F.split("line", r"\|")).alias("col", "value"), "is_header")
    return cells.select("doc_id", "table_line", "row", "col", F.trim("value").alias("value"), "is_header")


def markdown_toc(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, level, title, slug) of headings outside code fences."""
    lines = text_lines(df, id_col, text_col).where("not fenced and not fence")
    shape = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    found = lines.where(F.col("line").rlike(shape))
    title = F.regexp_extract("line", shape, 2)
    return found.select("doc_id", "line_no", F.length(F.regexp_extract("line", shape, 1)).alias("level"), title.alias("title"), slugify(title).alias("slug"))


#: Elements that sanitising removes.
WITH_CONTENT = ("script", "noscript")
REMOVED = ("iframe", "object", "embed", "style", "link", "meta", "base", "form", "input", "button", "textarea", "svg", "math")


def sanitize_html(html: Column) -> Column:
    """HTML without active content: elements that run or embed, on* attributes; scripting and data links lead to #."""
    for tag in WITH_CONTENT:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    names = "|".join(REMOVED)
    html = F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?</\1>", "")
    html = F.regexp_replace(html, rf"(?is)</?(?:{names}|{'|'.join(WITH_CONTENT)})\b[^>]*>", "")
    html = F.regexp_replace(html, r"""(?i)\s+on\w+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")
    quoted = "|".join(rf"{q}\s*(?:javascript:|data:text/html)[^{q}]*{q}" for q in "\"'")
    return F.regexp_replace(html, rf"(?i)(href|src)\s*=\s*(?:{quoted}|javascript:[^\s>]+)", '$1="#"')
