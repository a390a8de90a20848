"""Plans made from a profile or from preferences."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import names as nn
from dqengine.functions import text as tx
from dqengine.operators import columns as cols
from dqengine.operators import dates, dedup, nulls, numeric, texts
from dqengine.operators import profile as pf
from dqengine.operators import stats as st
from dqengine.plans.plan import ALL, Operation, Plan, Step
from dqengine.plans.prefs import DateFormat, MissingStrategy, NamingStyle, NumberFormat, Preferences, TextCase
from dqengine.session import materialize

# Parameters of the rules, and the caps of a plan meant to be read by a person.
SHORT_PLAN = {1: 10, 2: 8, 3: 3, 4: 3}
SHORT_STEPS = 12
FILL_PARAMS = '{"strategy": "fill_custom", "value": "N/A"}'
DATE_PARAMS = '{"format": "auto", "errors": "coerce"}'
NUMBER_PARAMS = '{"decimal_separator": "comma", "remove_currency": true, "errors": "coerce"}'
DUPLICATE_PARAMS = '{"keep": "first"}'


def suggest_steps(profile: DataFrame, caps: Mapping[int, int] | None = None, most: int | None = None) -> DataFrame:
    """Rows ``(step, operation_type, column_name, params)`` from a profile table.

    Irregular names, gaps in texts, texts named like dates or amounts, and
    duplicates when there are more than two columns; a generic pair when
    nothing applies. Every column that a rule hits gets its step, unless ``caps``
    (rule number to steps) or ``most`` (steps in all) shorten the plan.
    """
    name, text = F.col("name"), F.col("dtype") == "string"
    low = F.lower(name)
    rules = [
        (1, nn.needs_standardizing(name), Operation.STANDARDIZE_COLUMN_NAME, "{}"),
        (2, text & F.col("is_nullable"), Operation.HANDLE_NULLS, FILL_PARAMS),
        (3, text & tx.contains_any(low, cols.DATE_WORDS), Operation.CONVERT_TO_DATETIME, DATE_PARAMS),
        (4, text & tx.contains_any(low, cols.MONEY_WORDS), Operation.CONVERT_TO_NUMERIC, NUMBER_PARAMS),
    ]
    hits = [
        F.when(applies, _step(rule, op, name, params)) for rule, applies, op, params in rules
    ]
    capped = profile.select("position", F.inline(F.array_compact(F.array(*hits))))
    if caps:
        cap = F.coalesce(*[F.when(F.col("rule") == rule, n) for rule, n in caps.items()])
        within = Window.partitionBy("rule").orderBy("position")
        capped = capped.withColumn("nth", F.row_number().over(within)).filter(cap.isNull() | (F.col("nth") <= cap)).drop("nth")
    table = profile.agg(F.count("*").alias("n"), F.min_by("name", "position").alias("first"))
    everything = F.lit(ALL)
    duplicates = table.filter("n > 2").select(
        F.lit(0).alias("position"), F.inline(F.array(_step(5, Operation.REMOVE_DUPLICATES, everything, DUPLICATE_PARAMS)))
    )
    steps = capped.unionByName(duplicates)
    generic = table.select(
        F.posexplode(
            F.array(
                _step(6, Operation.STANDARDIZE_COLUMN_NAME, everything, "{}"),
                _step(7, Operation.HANDLE_NULLS, F.col("first"), FILL_PARAMS),
            )
        ).alias("position", "s")
    ).select("position", "s.*")
    none = steps.agg(F.count("*").alias("k")).scalar() == 0
    every = steps.unionByName(generic.filter(none))
    # a few rows a column
    order = Window.partitionBy(F.lit(1)).orderBy("rule", "position")
    numbered = every.withColumn("step", F.row_number().over(order))
    if most is not None:
        numbered = numbered.filter(F.col("step") <= most)
    return numbered.select("step", "operation_type", "column_name", "params")


def _step(rule: int, op: Operation, name: Column, params: str) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(op.value).alias("operation_type"),
        name.alias("column_name"),
        F.lit(params).alias("params"),
    )


def suggest_plan(profile: DataFrame, caps: Mapping[int, int] | None = None, most: int | None = None) -> Plan:
    """The suggested steps as a plan; a few rows a column come to the driver."""
    rows = suggest_steps(profile, caps, most).orderBy("step").collect()
    steps = tuple(Step(r["operation_type"], r["column_name"], json.loads(r["params"])) for r in rows)
    return Plan(steps, overall_summary=f"Cleaning plan with {len(steps)} steps")


def clean_with_preferences(
    df: DataFrame,
    prefs: Preferences,
    date_columns: Sequence[str] | None = None,
    number_columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    rules: Sequence[tuple[str, str]] = (),
    fill_value: object = 0,
) -> DataFrame:
    """Apply the preferences by kind of column, in a fixed order.

    Sparse columns, null tokens, encoding, texts, numbers, dates, gaps,
    outliers, rounding, duplicates, types, names. Without given date and number
    columns, texts whose names and values say so are taken.
    """
    df = cols.drop_sparse_columns(df, prefs.missing_threshold)
    df = nulls.normalize_nulls(df)
    texts_ = [c for c in df.columns if st.is_text(df, c)]
    if prefs.encoding_fix:
        df = texts.fix_encoding(df, texts_)
    if date_columns is None:
        date_columns = [c for c in texts_ if any(w in c.lower() for w in cols.DATE_WORDS)]
    if number_columns is None:
        number_columns = [c for c in texts_ if any(w in c.lower() for w in cols.MONEY_WORDS) and c not in date_columns]
    plain = [c for c in texts_ if c not in {*date_columns, *number_columns}]
    if plain:
        if prefs.remove_leading_trailing_spaces:
            df = texts.trim_text(df, plain)
        if prefs.normalize_whitespace:
            df = texts.normalize_whitespace(df, plain)
        df = texts.clean_text(df, plain, prefs.string_cleaning_level.value, rules)
        if prefs.string_case_style is not TextCase.KEEP_ORIGINAL:
            df = texts.convert_case(df, plain, prefs.string_case_style.value)
    if prefs.numeric_format is not NumberFormat.KEEP_ORIGINAL:
        for c in number_columns:
            df = _number(df, c, prefs)
    if prefs.date_format is not DateFormat.KEEP_ORIGINAL:
        for c in date_columns:
            df = _date(df, c, prefs)
    # written once: gaps, fences and fills below all read the cleaned cells, and none cleans them again
    df = materialize(df)
    df = _gaps(df, prefs, order_by, fill_value)
    numbers = [c for c in df.columns if isinstance(st.type_of(df, c), st.FLOATS)]
    if prefs.handle_outliers and numbers:
        df = numeric.outliers_iqr(df, numbers, action="clip")
    if prefs.decimal_places is not None and numbers:
        df = numeric.round_places(df, numbers, prefs.decimal_places)
    if prefs.memory_optimization:
        # chosen before duplicates go: these do not change the range of a column, and rows are compared once
        df = cols.optimize_types(materialize(df))
    if prefs.remove_duplicates:
        df = dedup.remove_duplicates(df)
    if prefs.column_naming_style is not NamingStyle.KEEP_ORIGINAL:
        df = cols.standardize_names(df, "all", prefs.column_naming_style.value)
    # the style already decides about spaces; a hyphen of kebab-case is part of it
    kebab = prefs.column_naming_style is NamingStyle.KEBAB_CASE
    return cols.clean_names(
        df, prefs.remove_column_spaces, prefs.remove_column_accents, prefs.remove_column_special_chars and not kebab
    )


def _number(df: DataFrame, column: str, prefs: Preferences) -> DataFrame:
    decimal = {
        NumberFormat.DECIMAL_DOT: "dot",
        NumberFormat.DECIMAL_COMMA: "comma",
        NumberFormat.AUTO_DETECT: "auto_detect",
    }[prefs.numeric_format]
    thousands = {"dot": ",", "comma": ".", "auto_detect": "auto"}[decimal] if prefs.handle_thousand_separators else None
    return numeric.to_numeric(df, column, decimal, prefs.remove_currency_symbols, thousands)


def _date(df: DataFrame, column: str, prefs: Preferences) -> DataFrame:
    how = prefs.handle_invalid_dates
    if how in ("drop", "fill_today"):
        df = dates.invalid_dates(df, column, how)
    else:
        df = dates.to_datetime(df, column)
    if not prefs.standardize_date_format:
        return df
    style = {DateFormat.US_FORMAT: "us", DateFormat.BR_FORMAT: "br"}.get(prefs.date_format)
    return dates.format_dates(df, [column], style) if style else df


def _gaps(df: DataFrame, prefs: Preferences, order_by: Sequence[str], fill_value: object) -> DataFrame:
    numbers = [c for c in df.columns if st.is_number(df, c)]
    others = [c for c in df.columns if st.is_text(df, c)]
    chosen = {c: prefs.numeric_missing_strategy for c in numbers}
    chosen |= {c: prefs.categorical_missing_strategy for c in others}
    active = {c: s for c, s in chosen.items() if s is not MissingStrategy.KEEP_AS_NULL}
    if not active:
        return df
    # one small job: only columns with gaps are filled, complete ones keep their type
    gaps = pf.missing_table(df.select(*map(st.quoted, active))).filter("n_missing > 0")
    found = {r["column"] for r in gaps.collect()}
    chosen = {c: s for c, s in active.items() if c in found}
    shared = {c: s.value for c, s in chosen.items() if s.value in nulls.STATISTICS}
    for c, s in shared.items():
        if c in others and s != "fill_mode":
            raise ValueError(f"{s} does not fit the text column {c}")
    drop = [c for c, s in chosen.items() if s is MissingStrategy.DROP_ROWS]
    for c in drop:
        df = df.filter(st.present(df, c).isNotNull())
    constants = {}
    for c, s in chosen.items():
        if s is MissingStrategy.FILL_ZERO:
            constants[c] = 0 if c in numbers else "0"
        elif s is MissingStrategy.FILL_CUSTOM:
            constants[c] = fill_value if c in numbers else prefs.categorical_fill_value
    df = nulls.fill_nulls(df, constants)
    if shared:
        df = nulls.fill_statistics(df, shared)
    for c, s in chosen.items():
        if s.value in nulls.ORDERED:
            df = nulls.fill_ordered(df, c, s.value, order_by)
    return df
