"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqengine.functions.text import SPACE, trim_text

# Characters removed as currency marks.
CURRENCY = "[R$€£¥₹]"
# Shapes of a number after separators were resolved, and of raw texts.
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DOT_DECIMAL = r"^[^,]*\.[0-9]+$|^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
COMMA_DECIMAL = r"^[^.]*,[0-9]+$|^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"
SPACE_THOUSANDS = r"^[0-9]{1,3}( [0-9]{3})+([.,][0-9]+)?$"


def strip_currency(c: Column) -> Column:
    return F.regexp_replace(c, CURRENCY, "")


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def strip_thousands(c: Column, sep: str) -> Column:
    """Remove the thousands mark: ``.``, ``,`` or a space."""
    if sep == " ":
        return F.regexp_replace(c, f"{SPACE}+", "")
    return F.replace(c, F.lit(sep), F.lit(""))


def to_number(
    c: Column, decimal: str = "dot", currency: bool = False, thousands: str | None = None
) -> Column:
    """Parse to double; anything that is not a number gives NULL."""
    c = c.cast("string")
    if currency:
        c = strip_currency(c)
    c = trim_text(c)
    if thousands:
        c = strip_thousands(c, thousands)
    if decimal == "comma":
        c = decimal_comma(c)
    elif decimal != "dot":
        raise ValueError(f"decimal is 'dot' or 'comma', not {decimal!r}")
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def bare_amount(c: Column) -> Column:
    """Text without currency marks and outer spaces, for looking at separators."""
    return trim_text(strip_currency(c))
