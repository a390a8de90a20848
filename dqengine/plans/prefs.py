"""Cleaning preferences: a choice per subject, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from enum import Enum
from pathlib import Path
from typing import get_type_hints


class NamingStyle(str, Enum):
    SNAKE_CASE = "snake_case"
    KEBAB_CASE = "kebab-case"
    CAMEL_CASE = "camelCase"
    PASCAL_CASE = "PascalCase"
    LOWER_UNDERSCORE = "lower_underscore"
    KEEP_ORIGINAL = "keep_original"


class TextCase(str, Enum):
    LOWER = "lower"
    UPPER = "upper"
    TITLE = "title"
    SENTENCE = "sentence"
    KEEP_ORIGINAL = "keep_original"


class NumberFormat(str, Enum):
    DECIMAL_DOT = "decimal_dot"
    DECIMAL_COMMA = "decimal_comma"
    AUTO_DETECT = "auto_detect"
    KEEP_ORIGINAL = "keep_original"


class DateFormat(str, Enum):
    ISO_FORMAT = "iso_format"
    US_FORMAT = "us_format"
    BR_FORMAT = "br_format"
    AUTO_DETECT = "auto_detect"
    KEEP_ORIGINAL = "keep_original"


class MissingStrategy(str, Enum):
    DROP_ROWS = "drop_rows"
    FILL_ZERO = "fill_zero"
    FILL_MEAN = "fill_mean"
    FILL_MEDIAN = "fill_median"
    FILL_MODE = "fill_mode"
    FILL_FORWARD = "fill_forward"
    FILL_BACKWARD = "fill_backward"
    FILL_CUSTOM = "fill_custom"
    KEEP_AS_NULL = "keep_as_null"


class CleaningLevel(str, Enum):
    MINIMAL = "minimal"
    MODERATE = "moderate"
    AGGRESSIVE = "aggressive"
    CUSTOM = "custom"


@dataclass(frozen=True)
class Preferences:
    """How a table is to be cleaned; the field names are those of the JSON document."""

    column_naming_style: NamingStyle = NamingStyle.SNAKE_CASE
    remove_column_spaces: bool = True
    remove_column_accents: bool = True
    remove_column_special_chars: bool = True
    string_case_style: TextCase = TextCase.KEEP_ORIGINAL
    string_cleaning_level: CleaningLevel = CleaningLevel.MINIMAL
    remove_leading_trailing_spaces: bool = True
    normalize_whitespace: bool = True
    numeric_format: NumberFormat = NumberFormat.AUTO_DETECT
    decimal_places: int | None = None
    remove_currency_symbols: bool = True
    handle_thousand_separators: bool = True
    date_format: DateFormat = DateFormat.AUTO_DETECT
    standardize_date_format: bool = True
    handle_invalid_dates: str = "keep"
    numeric_missing_strategy: MissingStrategy = MissingStrategy.KEEP_AS_NULL
    categorical_missing_strategy: MissingStrategy = MissingStrategy.KEEP_AS_NULL
    categorical_fill_value: str = "N/A"
    missing_threshold: float = 0.7
    remove_duplicates: bool = True
    handle_outliers: bool = False
    encoding_fix: bool = True
    memory_optimization: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Preferences:
        """All fields must be there and of their kind."""
        given = json.loads(text)
        if missing := {f.name for f in fields(cls)} - set(given):
            raise ValueError(f"preferences lack {sorted(missing)}")
        kinds = get_type_hints(cls)
        return cls(
            **{
                f.name: kinds[f.name](given[f.name]) if isinstance(kinds[f.name], type) and issubclass(kinds[f.name], Enum) else given[f.name]
                for f in fields(cls)
            }
        )

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Preferences | None:
        """None where there is no readable document."""
        try:
            return cls.from_json(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None
