"""Text expressions. Every function takes and returns a ``Column``."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accents() -> tuple[str, str]:
    """Latin letters with marks and the plain letters below them, by their canonical decomposition."""
    pairs = {chr(p): unicodedata.normalize("NFD", chr(p))[0] for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    pairs = {c: plain for c, plain in pairs.items() if plain != c and plain.isascii()}
    pairs |= dict(zip("ŁłĐđØøĦħŦŧ", "LlDdOoHhTt"))  # strokes have no decomposition
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
MARKS = "".join(map(chr, range(0x300, 0x370)))  # combining marks, dropped where they stand alone

# The blanks of Unicode, and their regular expression.
BLANKS = r" \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{BLANKS}]"

# Punctuation that the moderate cleaning level keeps.
KEPT_PUNCTUATION = r".,;:!?'\"()\-/@%&"


def remove_accents(c: Column) -> Column:
    """Plain letters for accented Latin ones, composed or not, case kept. Other alphabets stay."""
    return F.translate(c, ACCENTED + MARKS, PLAIN)


def trim_text(c: Column) -> Column:
    """Drop whitespace (not only spaces) at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """One space for every run of whitespace."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def clean_minimal(c: Column) -> Column:
    # after the runs of whitespace became spaces, plain trim is enough
    return F.trim(normalize_whitespace(c))


def clean_moderate(c: Column) -> Column:
    """Keep letters, digits, spaces and plain punctuation."""
    return clean_minimal(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{BLANKS}{KEPT_PUNCTUATION}]+", ""))


def clean_aggressive(c: Column) -> Column:
    """Lower case, no accents, only ``a-z``, digits and single spaces."""
    return clean_minimal(F.regexp_replace(F.lower(remove_accents(c)), rf"[^a-z0-9{BLANKS}]+", ""))


def clean_custom(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ``(pattern, replacement)`` pairs in order."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def clean_text(c: Column, level: str = "minimal", rules: Sequence[tuple[str, str]] = ()) -> Column:
    levels = {
        "minimal": clean_minimal,
        "moderate": clean_moderate,
        "aggressive": clean_aggressive,
        "custom": lambda x: clean_custom(x, rules),
    }
    if level not in levels:
        raise ValueError(f"unknown cleaning level {level!r}")
    return levels[level](c)


def remove_control_chars(c: Column) -> Column:
    """Drop control characters except tab and newline."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def looks_misdecoded(c: Column) -> Column:
    """True where UTF-8 bytes were read as Latin-1 (``SÃ£o``)."""
    return c.rlike("[ÃÂ][\u0080-¿]") & c.rlike("^[\u0000-ÿ]*$")


def fix_encoding(c: Column) -> Column:
    """Undo a UTF-8 text read as Latin-1, only where the damage shows."""
    raw = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(looks_misdecoded(c) & F.is_valid_utf8(raw), raw).otherwise(c)


def title_case(c: Column) -> Column:
    """Upper case at the start of every run of letters (``o'neil a1b`` -> ``O'Neil A1B``)."""
    # initcap only starts words at spaces: other breaks get a marked space for its time
    low = F.lower(c)
    broken = F.regexp_replace(low, r"([^\p{L} ])(\p{L})", "$1\u0001 $2")
    marked = F.replace(F.initcap(broken), F.lit("\u0001 "), F.lit(""))
    # a text that holds the mark itself is cut where a letter follows something else
    pieces = F.array_join(F.transform(F.split(low, r"(?<=[^\p{L}])(?=\p{L})"), _capital), "")
    return F.when(F.contains(c, F.lit("\u0001")), pieces).otherwise(marked)


def _capital(word: Column) -> Column:
    first = F.upper(F.substring(word, 1, 1))
    # one letter may grow to two (``ß`` -> ``Ss``): only the first of them is upper case
    grown = F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, F.lit(2), F.length(first))))
    return F.concat(grown, F.substring(word, F.lit(2), F.length(word)))


def sentence_case(c: Column) -> Column:
    return _capital(F.lower(c))


def convert_case(c: Column, case: str = "lower") -> Column:
    cases = {
        "lower": F.lower,
        "upper": F.upper,
        "title": title_case,
        "sentence": sentence_case,
        "keep_original": lambda x: x,
    }
    if case not in cases:
        raise ValueError(f"unknown case {case!r}")
    return cases[case](c)


def words(c: Column) -> Column:
    """Lower-case whitespace-separated words, repeats kept, blanks dropped."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda w: w != "")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True where the lower-cased text holds at least one term."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.lower(c).contains(term)
    return hit
