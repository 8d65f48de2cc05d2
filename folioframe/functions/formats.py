"""Number and date formats: a pattern is parsed once, on the driver, into a description from which the Column is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.scalar import js_number, js_round, parse_date_like, serial_days

#: Number-format ids of spreadsheets and the tokens that stand for them; ids of dates; the characters that a
#: custom pattern may consist of; patterns that mean the currency token; names that date patterns print.
FORMAT_TOKENS = {1: "int", 2: "0.00", 3: "thousands", 4: "thousands2", 9: "percent", 10: "percent2", 14: "date", 49: "@"}
DATE_FORMAT_IDS = (*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59))
SAFE_PATTERN = r'^[0#.,%\s"\-/:年月日hmsHMSyYdD+$€£¥￥@]+$'
CURRENCY_PATTERNS = ("¥#,##0.00", "￥#,##0.00", '"¥"#,##0.00')
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def to_fixed(value: Column, digits: int, grouped: bool = False) -> Column:
    """Decimal text with so many digits; exact ties go away from zero, all else by the exact binary value."""
    scale = float(10**digits)
    size = F.abs(value)
    tie = (size * float(2 ** (digits + 1)) == F.floor(size * float(2 ** (digits + 1)))) & (size * scale - F.floor(size * scale) == 0.5)
    text = F.format_number(F.when(tie, (F.floor(size * scale) + 1) / scale).otherwise(size), digits)
    text = text if grouped else F.replace(text, F.lit(","), F.lit(""))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


@dataclass(frozen=True)
class NumberShape:
    """How a number is shown: a prefix, decimals, grouping by thousands, as a percentage; trimmed: without trailing zeros."""

    decimals: int = 0
    grouped: bool = False
    percent: bool = False
    prefix: str = ""
    trimmed: bool = False
    whole: bool = False

    def show(self, n: Column) -> Column:
        if self.whole:
            return js_round(n).cast("long").cast("string")
        digits = to_fixed(n * 100 if self.percent else n, self.decimals, self.grouped)
        if self.trimmed:
            digits = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.concat(F.lit(self.prefix), digits, F.lit("%" if self.percent else ""))


NAMED = {
    "int": NumberShape(whole=True), "0.00": NumberShape(2), "thousands": NumberShape(3, grouped=True, trimmed=True), "thousands2": NumberShape(2, grouped=True),
    "percent": NumberShape(percent=True), "percent2": NumberShape(2, percent=True), "currency": NumberShape(2, grouped=True, prefix="¥"),
}

_SHAPE = re.compile(r'\s*(?:"(?P<quoted>[^"]+)")?(?P<sign>[¥￥$€£])?\s*(?P<whole>[#,0]*)(?:\.(?P<part>[0#]+))?(?P<percent>%)?\s*')


def number_shape(pattern: str) -> NumberShape | None:
    """The shape that a token or a pattern like ¥#,##0.00 describes; None if it describes none."""
    if pattern in NAMED:
        return NAMED[pattern]
    m = _SHAPE.fullmatch(pattern)
    return m and NumberShape(len(m["part"] or ""), "," in m["whole"], bool(m["percent"]), m["quoted"] or m["sign"] or "")


def date_parts(pattern: str) -> list[tuple[str, str]]:
    """(kind, text) of a date pattern: runs of one of the letters y m d h s as fields, all else as it is.

    A single letter is a field only between characters that are no ASCII letters, digits or underscores. A run of m
    is the month up to the hour that a colon follows, and the minute from there on.
    """
    hour = re.search(r"h+\s*[:：]", pattern, re.I)
    parts = []
    for run in re.finditer(r"(?i)([ymdhs])\1*|[^ymdhs]+", pattern):
        kind, around = "text", pattern[max(run.start() - 1, 0) : run.start()] + pattern[run.end() : run.end() + 1]
        if run[1] and (len(run[0]) > 1 or not re.search(r"\w", around, re.ASCII)):
            late = run[1] in "mM" and hour is not None and run.start() >= hour.start()
            kind = run[0].lower().replace("m", "n") if late else run[0].lower()
        parts.append((kind, run[0]))
    return parts


def format_date(ts: Column, pattern: str) -> Column:
    """Text of a timestamp by yyyy yy mmm mm m dddd dd d hh h ss s; other runs of letters stay as they are."""
    plain = {"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts), "h": F.hour(ts), "n": F.minute(ts), "s": F.second(ts)}
    fields = {k: v.cast("string") for k, v in plain.items() if k != "y"}
    fields |= {k * 2: F.lpad((v % 100).cast("string"), 2, "0") for k, v in plain.items()}
    fields["yyyy"] = plain["y"].cast("string")
    fields["mmm"] = F.get(F.array(*map(F.lit, MONTHS)), F.month(ts) - 1)
    fields["dddd"] = F.get(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(ts) - 1)
    return F.concat(*[fields.get(kind, F.lit(text)) for kind, text in date_parts(pattern)], F.lit(""))


def format_value(value: Column, token: str) -> Column:
    """Display text of a cell by a number-format token or pattern; what it doesn't fit passes through."""
    number = F.when(F.trim(value) != "", js_number(value))
    dated = token not in NAMED and bool(re.search("(?i)[ymdhs]", token)) and bool(re.search(r"[-/ :]", token))
    shape = None if dated or token == "date" else number_shape(token)
    if dated:
        # A number is a day, if it lies in the calendar; other text may be a date as it is.
        day = F.when(number.isNull(), parse_date_like(value)).when((number > 0) & (number < 60_000), serial_days(number))
        return F.coalesce(format_date(day, token), value)
    return F.coalesce(shape.show(number), value) if shape else value


def fmt_token(fmt_id: Column, custom: Column) -> Column:
    """Token of a number-format id, or of a custom pattern; empty if neither is known."""
    pattern = F.trim(F.coalesce(custom, F.lit("")))
    named = F.create_map(*[F.lit(x) for i in DATE_FORMAT_IDS for x in (i, "date")], *[F.lit(x) for i, t in FORMAT_TOKENS.items() if t != "date" for x in (i, t)])
    own = F.when(pattern.isin(*CURRENCY_PATTERNS), "currency").when(pattern.rlike(SAFE_PATTERN), pattern)
    return F.coalesce(F.try_element_at(named, fmt_id.cast("int")), own, F.lit(""))


def fmt_id(token: Column) -> Column:
    """struct(id, custom) of a token; null fields if it isn't known."""
    ids = F.create_map(*[F.lit(x) for i, t in FORMAT_TOKENS.items() for x in (t, i)])
    known = F.try_element_at(ids, token)
    custom = F.when(token == "currency", CURRENCY_PATTERNS[0]).when(known.isNotNull(), "").when(token.rlike(SAFE_PATTERN), token)
    return F.struct(F.when(custom.isNotNull(), F.coalesce(known, F.lit(0))).alias("id"), custom.alias("custom"))
