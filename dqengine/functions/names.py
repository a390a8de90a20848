"""Column-name styles, for names of a table and for names held as data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqengine.functions import text as tx

# Joining words, replaced by one underscore in this order.
JOINING_WORDS = (" - ", " da ", " de ", " do ", " das ", " dos ")
# Single characters that turn into an underscore, and dropped ones.
TO_UNDERSCORE = " -/\\"
DROPPED = "().,:"
# Characters that make a name need standardising.
IRREGULAR = r"[ \-()/\\.:]"
# One pattern per naming style, tried in this order.
STYLE_PATTERNS = (
    ("snake_case", "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"),
    ("kebab-case", "^[a-z][a-z0-9]*(-[a-z0-9]+)+$"),
    ("camelCase", "^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"),
    ("PascalCase", "^([A-Z][a-z0-9]*)+$"),
)
STYLES = ("snake_case", "kebab-case", "camelCase", "PascalCase", "lower_underscore", "keep_original")


def snake_case(c: Column) -> Column:
    """``Data da Coleta`` -> ``data_coleta``; accents and ``$`` stay."""
    joined = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("_")), JOINING_WORDS, F.lower(c))
    # translate drops the characters that have no partner in the second list
    flat = F.translate(joined, TO_UNDERSCORE + DROPPED, "_" * len(TO_UNDERSCORE))
    return F.regexp_replace(F.regexp_replace(flat, "_+", "_"), "^_|_$", "")


def snake_case_name(name: str) -> str:
    """The same for one name of a schema."""
    joined = reduce(lambda x, w: x.replace(w, "_"), JOINING_WORDS, name.lower())
    table = {ord(ch): "_" for ch in TO_UNDERSCORE} | {ord(ch): None for ch in DROPPED}
    return re.sub("_+", "_", joined.translate(table)).strip("_")


def style_case(c: Column, style: str) -> Column:
    """A name held as data, written in ``style``."""
    if style in ("snake_case", "lower_underscore"):
        return snake_case(c)
    if style == "keep_original":
        return c
    parts = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lowered = F.transform(parts, F.lower)
    if style == "kebab-case":
        return F.array_join(lowered, "-")
    pascal = F.array_join(F.transform(lowered, tx.sentence_case), "")
    if style == "PascalCase":
        return pascal
    if style == "camelCase":
        return F.concat(
            F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, F.lit(2), F.length(pascal))
        )
    raise ValueError(f"unknown naming style {style!r}")


def style_name(name: str, style: str) -> str:
    """The same for one name of a schema."""
    if style in ("snake_case", "lower_underscore"):
        return snake_case_name(name)
    if style == "keep_original":
        return name
    parts = [p.lower() for p in re.split(r"[^\w]+|_", name) if p]
    if style == "kebab-case":
        return "-".join(parts)
    pascal = "".join(p[:1].upper() + p[1:] for p in parts)
    if style == "PascalCase":
        return pascal
    if style == "camelCase":
        return pascal[:1].lower() + pascal[1:]
    raise ValueError(f"unknown naming style {style!r}")


def clean_name(c: Column, spaces: bool = True, accents: bool = True, specials: bool = True) -> Column:
    """Remove spaces, accents and other characters outside letters, digits, ``_``."""
    if accents:
        c = tx.remove_accents(c)
    if spaces:
        c = F.regexp_replace(c, f"{tx.SPACE}+", "")
    if specials:
        c = F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_ ]", "")
    return c


def clean_plain_name(name: str, spaces: bool, accents: bool, specials: bool) -> str:
    """The same for one name of a schema."""
    if accents:
        name = name.translate(str.maketrans(tx.ACCENTED, tx.PLAIN, tx.MARKS))
    if spaces:
        name = re.sub(r"\s+", "", name)
    if specials:
        name = re.sub(r"[^\w ]", "", name)
    return name


def needs_standardizing(c: Column) -> Column:
    return c.rlike(IRREGULAR)


def has_accents(c: Column) -> Column:
    return tx.remove_accents(c) != c


def name_style(c: Column) -> Column:
    """The first style whose pattern the name follows, else ``other``."""
    out = F.lit("other")
    for style, pattern in reversed(STYLE_PATTERNS):
        out = F.when(c.rlike(pattern), F.lit(style)).otherwise(out)
    return out
