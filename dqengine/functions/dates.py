"""Dates written as text. Results are ``timestamp_ntz``: no time zone takes part."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqengine.functions.text import trim_text

# Shape of each named text format and the order of day, month, year in it.
FORMATS = {
    "br_format": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "dmy"),
    "iso_format": (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "ymd"),
    "us_format": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "mdy"),
}
# What "auto" reads, day first where unclear, each with an optional time.
CLOCK = r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?"
COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
# A zone after a clock, ``Z`` or an offset in hours and minutes.
ZONE = r"(:[0-9]{2}(?:\.[0-9]{1,9})?) ?(?:Z|([+-][0-9]{2}):?([0-9]{2}))$"
AUTO = (
    (rf"^[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\1[0-9]{{4}}{CLOCK}$", "dmy"),
    (rf"^[0-9]{{4}}([-/])[0-9]{{1,2}}\1[0-9]{{1,2}}{CLOCK}$", "ymd"),
)
# Days with two digits for the year, and with the month's English name.
SHORT_YEAR = rf"^([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2([0-9]{{2}})({CLOCK})$"
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY_MONTH = rf"(?i)^([0-9]{{1,2}})(?:st|nd|rd|th)?(?: of)?[-/. ]? ?{MONTH}[.,]?[-/ ]? ?([0-9]{{4}}|[0-9]{{2}})({CLOCK})$"
MONTH_DAY = rf"(?i)^{MONTH}[.]?[- ]([0-9]{{1,2}})(?:st|nd|rd|th)?(?:, ?|[- ])([0-9]{{4}}|[0-9]{{2}})({CLOCK})$"
MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
MAYBE_SPELLED = r"[A-Za-z]{3}|^[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{2}([ T]|$)"
# Two digits from here on are the last century's.
CENTURY_TURN = 69
# Output patterns of each style.
STYLES = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "br": "dd/MM/yyyy"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once. For rare branches: they stay out of the generated code."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _made(c: Column, order: str) -> Column:
    """The timestamp of the numbers in the text; no such day gives NULL, without an exception per row."""
    parts = F.split(c, "[-/. T:]")

    def number(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))

    day, month, year = (number(order.index(unit)) for unit in "dmy")
    fraction = F.concat(F.lit("0."), F.get(parts, F.lit(6))).try_cast("decimal(16,6)")
    second = number(5).cast("decimal(16,6)") + F.coalesce(fraction, F.lit(0))
    return F.try_make_timestamp_ntz(year, month, day, number(3), number(4), second.cast("decimal(16,6)"))


def _zoned(c: Column) -> Column:
    """A time with a zone, brought to UTC; the text without it must fit one of the shapes."""
    made = _let(F.regexp_replace(c, ZONE, "$1"), _plain)
    hours, minutes = (F.coalesce(F.regexp_extract(c, ZONE, i).try_cast("int"), F.lit(0)) for i in (2, 3))
    sign = F.when(F.regexp_extract(c, ZONE, 2).startswith("-"), -1).otherwise(1)
    return made - F.make_dt_interval(F.lit(0), hours, sign * minutes)


def _spelled(c: Column) -> Column:
    """Days with a month's name or a short year, written as day/month/year with four digits; others stay."""

    def part(shape: str, i: int) -> Column:
        return F.regexp_extract(c, shape, i)

    def year(digits: Column) -> Column:
        short = F.when(digits.try_cast("int") >= CENTURY_TURN, F.concat(F.lit("19"), digits)).otherwise(F.concat(F.lit("20"), digits))
        return F.when(F.length(digits) == 2, short).otherwise(digits)

    def written(day: Column, number: Column, digits: Column, clock: Column) -> Column:
        return F.concat_ws("/", day, number, F.concat(year(digits), clock))

    named = [(DAY_MONTH, 1, 2), (MONTH_DAY, 2, 1)]
    out = F.when(c.rlike(SHORT_YEAR), written(part(SHORT_YEAR, 1), part(SHORT_YEAR, 3), part(SHORT_YEAR, 4), part(SHORT_YEAR, 5)))
    for shape, day, name in named:
        number = (F.instr(F.lit(MONTH_STARTS), F.lower(F.substring(part(shape, name), 1, 3))) + 2) / 3
        out = out.when(c.rlike(shape), written(part(shape, day), number.cast("int").cast("string"), part(shape, 3), part(shape, 4)))
    return out.otherwise(c)


def _shaped(c: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("timestamp_ntz")
    for shape, order in reversed(shapes):
        out = F.when(c.rlike(shape), _made(c, order)).otherwise(out)
    return out


def _rare(c: Column) -> Column:
    """A day in one of the ways that ``AUTO`` does not list."""
    compact = F.when(c.rlike(COMPACT), _made(F.regexp_replace(c, COMPACT, "$1-$2-$3"), "ymd"))
    return compact.when(c.rlike(MAYBE_SPELLED), _let(_spelled(c), lambda x: _shaped(x, AUTO[:1])))


def _plain(c: Column) -> Column:
    """A day, with or without a clock, in any way that ``auto`` reads but a zone."""
    return F.coalesce(_shaped(c, AUTO), _let(c, _rare))


def parse_date(c: Column, format: str = "auto") -> Column:
    """Parse text to a timestamp; text that is no date gives NULL.

    ``auto`` also reads fractions of a second, eight digits as year, month and day, times with
    a zone, which become UTC, years of two digits (69 to 99 are the last century's), and English names of months.
    """
    if format != "auto" and format not in FORMATS:
        raise ValueError(f"unknown date format {format!r}")
    c = trim_text(c)
    if format != "auto":
        return _shaped(c, (FORMATS[format],))
    return F.coalesce(_shaped(c, AUTO), _let(c, lambda x: F.when(x.rlike(ZONE), _zoned(x)).otherwise(_rare(x))))


def format_date(c: Column, style: str = "iso") -> Column:
    if style == "keep_original":
        return c
    if style not in STYLES:
        raise ValueError(f"unknown date style {style!r}")
    return F.date_format(c, STYLES[style])
