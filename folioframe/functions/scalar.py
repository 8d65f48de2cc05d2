"""Scalar functions as Column expressions: references, numbers, dates, formats, arithmetic, names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
MAX_COLUMN = 16_384


# References ---------------------------------------------------------------------------------------------------------


def col_name(n: Column) -> Column:
    """Letters of a 1-based column number, up to 16384 (XFD); null beyond."""
    letter = lambda x: F.char(F.lit(65) + x)
    one = letter((n - 1) % 26)
    two = letter(F.floor((n - 27) / 26) % 26)
    three = letter(F.floor((n - 703) / 676))
    name = F.when(n > 702, F.concat(three, two, one)).when(n > 26, F.concat(two, one)).otherwise(one)
    return F.when((n >= 1) & (n <= MAX_COLUMN), name)


def col_number(name: Column) -> Column:
    """1-based number of column letters, case and $ ignored; null if they are none, or beyond 16384."""
    letters = F.split(F.regexp_extract(F.upper(F.replace(name, F.lit("$"), F.lit(""))), "^[A-Z]{1,3}$", 0), "")
    n = F.aggregate(letters, F.lit(0), lambda s, x: s * 26 + F.ascii(x) - F.when(x == "", 0).otherwise(64))
    return F.nullif(F.when(n <= MAX_COLUMN, n), F.lit(0))


def cell_ref(col: Column, row: Column, absolute: bool = False) -> Column:
    """A1 name of 1-based coordinates."""
    mark = F.lit("$" if absolute else "")
    return F.concat(mark, col_name(col), mark, row.cast("string"))


def parse_ref(ref: Column) -> Column:
    """struct(col, row), 1-based, of an A1 name; null fields if it is none."""
    shape = r"^\s*\$?([A-Za-z]{1,3})\$?([0-9]{1,7})\s*$"
    row = F.nullif(F.regexp_extract(ref, shape, 2).try_cast("int"), F.lit(0))
    return F.struct(col_number(F.regexp_extract(ref, shape, 1)).cast("int").alias("col"), row.alias("row"))


def parse_range(ref: Column) -> Column:
    """struct(c1, r1, c2, r2), 1-based with corners sorted, of `A1` or `A1:B2`; null if either corner is no name."""
    corners = F.transform(F.split(ref, ":"), parse_ref)

    def sorted_corners(c: Column) -> Column:
        cols, rows = F.transform(c, lambda x: x["col"]), F.transform(c, lambda x: x["row"])
        whole = ~F.exists(c, lambda x: x["col"].isNull() | x["row"].isNull()) & (F.size(c) <= 2)
        made = F.struct(F.array_min(cols).alias("c1"), F.array_min(rows).alias("r1"), F.array_max(cols).alias("c2"), F.array_max(rows).alias("r2"))
        return F.when(whole, made)

    # Bound once: the parsed corners are used several times.
    return F.element_at(F.transform(F.array(corners), sorted_corners), 1)


# Numbers ------------------------------------------------------------------------------------------------------------


def js_number(value: Column) -> Column:
    """The whole string as a number; blank is 0; null where it is none (hexadecimal and Infinity included)."""
    s = F.trim(value)
    return F.when(s == "", F.lit(0.0)).when(s.rlike(_NUMBER), s.cast("double"))


def parse_float(value: Column) -> Column:
    """The number that the string begins with; null without one."""
    return F.when(value.rlike(_PREFIX), F.regexp_extract(value, _PREFIX, 1).cast("double"))


def js_round(value: Column, digits: int = 0) -> Column:
    """Half towards positive infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def half_away(value: Column, digits: int = 0) -> Column:
    """Half away from zero, of the binary value times a power of ten, as SQL engines round doubles; F.round goes by the shortest decimals."""
    scale = float(10**digits)
    x = F.abs(value * scale)
    return F.signum(value) * (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)) / scale


# Dates --------------------------------------------------------------------------------------------------------------

_EPOCH = "1899-12-30 00:00:00"


def serial_days(serial: Column) -> Column:
    """Timestamp of a day number from 1899-12-30, to the millisecond."""
    return F.timestamp_millis((F.floor(serial * 86_400_000 + 0.5)).cast("long") - 2_209_161_600_000)


def serial_to_ts(serial: Column, date1904: bool = False) -> Column:
    """Timestamp of a day number; null below 0. Up to day 61 to the microsecond; later ones to the second, the half of one down."""
    start = (-2_082_844_800 if date1904 else -2_209_161_600) * 1_000_000
    exact = F.floor(serial * 86_400_000_000 + 0.5).cast("long")
    # Half a microsecond of rounding is forgiven, in the day's fraction, which is exact; whole milliseconds beyond 500 round up.
    day = F.floor(serial)
    thousandths = F.floor((serial - day) * 86_400_000 + 5e-4)
    second = (day * 86_400 + F.floor((thousandths + 499) / 1000)).cast("long") * 1_000_000
    return F.when(serial >= 0, F.timestamp_micros(F.when(serial < 62, exact).otherwise(second) + start))


def ts_to_serial(ts: Column, date1904: bool = False) -> Column:
    """Day number of a timestamp; from 1 March 1900 one more, as if 29 February 1900 had been; 0 before the first day."""
    first, zero = (-2_209_075_200, 25_568) if not date1904 else (-2_082_844_800, 24_107)
    micros = F.unix_micros(ts)
    leap = F.lit(0) if date1904 else F.when(micros >= -2_203_891_200_000_000, 1).otherwise(0)
    # Days from 1970 first: they have the finer fractions.
    return F.when(micros < first * 1_000_000, F.lit(0.0)).otherwise(micros / 86_400_000_000 + (leap + zero))


def parse_date_like(value: Column) -> Column:
    """Timestamp of `Y-M-D` or `Y/M/D`, with ` h:m` or `Th:m:s` if there is a time; null otherwise."""
    s = F.trim(value)
    # The shapes that are read; a month of 13, or a day that its month lacks, is no date here.
    shape = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(s, shape, i), F.lit("9999")), F.lit(0)).cast("int")
    return F.when(s.rlike(shape), F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)")))


# Sheet arithmetic ---------------------------------------------------------------------------------------------------


def sheet_value(number: Column, error: Column | None = None) -> Column:
    return F.struct(number.cast("double").alias("number"), (F.lit(None) if error is None else error).cast("string").alias("error"))


def sheet_operand(value: Column) -> Column:
    """A cell's text as an operand: blank is 0, text is not a number."""
    return sheet_value(F.coalesce(js_number(F.coalesce(value, F.lit(""))), F.lit(float("nan"))))


def sheet_op(op: str, a: Column, b: Column) -> Column:
    """a op b of two operands, op one of + - * / ^; an error of either goes on, division by zero is one."""
    x, y = a["number"], b["number"]
    power = F.pow(x, y)
    result = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / F.when(y == 0, F.lit(1.0)).otherwise(y)), "^": power}[op]
    known = F.coalesce(a["error"], b["error"])
    error = known if op != "/" else F.coalesce(known, F.when(y == 0, "#DIV/0!"))
    return sheet_value(F.when(error.isNull(), result), error)


def sheet_result(value: Column) -> Column:
    """Text of a final value: an error's name, #ERROR for what isn't finite."""
    n = value["number"]
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    whole = finite & (n == F.floor(n)) & (F.abs(n) < 1e15)
    text = F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))
    return F.when(value["error"] == "#DIV/0!", "#DIV/0!").when(value["error"].isNotNull(), value["error"]).when(finite, text).otherwise("#ERROR")


# Names and markup ---------------------------------------------------------------------------------------------------


def is_checkable(word: Column, lang: str = "en") -> Column:
    """Tokens that spell checking looks at: more than one byte, not a number; CJK for zh (two characters or more), none of it otherwise."""
    cjk = word.rlike(r"[㐀-䶿一-鿿]")
    useful = (F.octet_length(word) > 1) & ~word.rlike(r"^[0-9.,]+$")
    return useful & (F.length(word) > 1) & cjk if lang == "zh" else useful & ~cjk


def _osa(a: str, b: str) -> int:
    """The distance by bits of a column of the table, a bit for each character of a (Hyyro, 2003)."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rises, falls, same, before = every, 0, 0, 0
    for c in b:
        at = places.get(c, 0)
        swapped = ((~same & at) << 1) & before
        same = ((((at & rises) + rises) ^ rises) | at | falls | swapped) & every
        up, down = falls | ~(same | rises) & every, same & rises
        found += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rises, falls, before = (down | ~(same | up)) & every, up & same & every, at
    return found


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: insertions, deletions, substitutions and swaps of neighbours, none edited twice.

    Pairs are compared in Python, a step for each character of b: as higher-order functions, a step for each cell of the table
    took a hundred times as long.
    """

    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return F.pandas_udf(distances, "int")(a, b)


def outline_level(style: Column, level: Column, rule: str = "editor") -> Column:
    """Level of a heading: the explicit one, else the number in the style's name (1 to 9; library rule: HEADINGn or Hn, 1 to 6)."""
    if rule == "library":
        return F.when(F.upper(style).rlike(r"^(HEADING|H)[1-6]$"), F.regexp_extract(F.upper(style), r"([1-6])$", 1).cast("int"))
    shape = r"(?i)^heading\s*([1-9])$" if rule == "docx" else r"(?:^|\D)([1-9])$"
    named = F.when(style.rlike(shape), F.regexp_extract(style, shape, 1).cast("int"))
    return F.coalesce(F.when(level >= 1, level), named)


def slugify(title: Column) -> Column:
    """Lower case; only word characters, CJK, spaces and hyphens stay; spaces become hyphens, runs of them one, a leading one too."""
    # The characters that stay.
    s = F.regexp_replace(F.lower(title), r"[^\w一-龥\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"-+", "-"))


def escape_html(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def fold_math(text: Column) -> Column:
    """White space inside $$...$$, then inside $...$, folded to one space."""

    def fold(value: Column, mark: str) -> Column:
        parts = F.split(value, re.sub(r"\$", r"\\$", mark))
        closed = F.size(parts) - 1
        return F.array_join(
            F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < closed), F.trim(F.regexp_replace(x, r"\s+", " "))).otherwise(x)), mark
        )

    return fold(fold(text, "$$"), "$")
