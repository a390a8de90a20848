"""Cleaning plans: an ordered list of typed steps, applied as one chain of DataFrame operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions.names import style_name
from dqengine.operators import aggregate as ag
from dqengine.operators import columns as cols
from dqengine.operators import dates, dedup, nulls, numeric, texts
from dqengine.operators import stats as st

ALL = "all_columns"


class Operation(str, Enum):
    # Operation names of a plan's JSON.
    STANDARDIZE_COLUMN_NAME = "standardize_column_name"
    HANDLE_NULLS = "handle_nulls"
    CONVERT_CASE = "convert_case"
    CHANGE_DATATYPE = "change_datatype"
    FILTER_ROWS = "filter_rows"
    AGGREGATE = "aggregate"
    REMOVE_DUPLICATES = "remove_duplicates"
    DERIVE_COLUMN = "derive_column"
    RENAME_COLUMN = "rename_column"
    CONVERT_TO_DATETIME = "convert_to_datetime"
    CONVERT_TO_NUMERIC = "convert_to_numeric"
    FILL_NULLS = "fill_nulls"
    NORMALIZE = "normalize"
    FEATURE_ENGINEERING = "feature_engineering"
    DATA_VISUALIZATION = "data_visualization"


@dataclass(frozen=True)
class Step:
    operation_type: Operation
    column_name: str | None = None
    params: Mapping[str, object] = field(default_factory=dict)
    justification: str = ""
    expected_outcome: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "operation_type", Operation(self.operation_type))


@dataclass(frozen=True)
class Plan:
    transformation_steps: tuple[Step, ...]
    initial_data_overview_summary: str = ""
    final_output_format: str = "parquet"
    overall_summary: str = "Data cleaning and standardization"
    requires_confirmation: bool = True

    def to_json(self) -> str:
        steps = [
            {
                "operation_type": s.operation_type.value,
                "column_name": s.column_name,
                "params": dict(s.params),
                "justification": s.justification,
                "expected_outcome": s.expected_outcome,
            }
            for s in self.transformation_steps
        ]
        return json.dumps({**self.__dict__, "transformation_steps": steps}, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        given = json.loads(text)
        if given.get("final_output_format", "parquet") != "parquet":
            raise ValueError("the output format is parquet")
        return cls(**{**given, "transformation_steps": tuple(Step(**s) for s in given.get("transformation_steps", []))})


class Names:
    """Where each original column name is now."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.now = {c: c for c in columns}

    def __call__(self, name: str) -> str:
        return self.now.get(name, name)

    def follow(self, before: Sequence[str], after: Sequence[str]) -> None:
        moved = dict(zip(before, after))
        self.now = {old: moved.get(new, new) for old, new in self.now.items()}


# What a step of each kind may be given.
PARAMS: dict[Operation, set[str]] = {
    Operation.STANDARDIZE_COLUMN_NAME: {"style"},
    Operation.HANDLE_NULLS: {"strategy", "value", "by", "partition_by", "order_by", "limit", "approx"},
    Operation.CONVERT_CASE: {"case"},
    Operation.CHANGE_DATATYPE: {"type", "errors"},
    Operation.FILTER_ROWS: {"condition"},
    Operation.AGGREGATE: {"by", "what", "approx"},
    Operation.REMOVE_DUPLICATES: {"keep", "order_by", "subset"},
    Operation.DERIVE_COLUMN: {"expression"},
    Operation.RENAME_COLUMN: {"new_name"},
    Operation.CONVERT_TO_DATETIME: {"format", "errors"},
    Operation.CONVERT_TO_NUMERIC: {"decimal_separator", "remove_currency", "thousands", "errors"},
    Operation.FILL_NULLS: {"strategy", "value", "by", "partition_by", "order_by", "limit", "approx"},
    Operation.NORMALIZE: {"method"},
    Operation.FEATURE_ENGINEERING: {"kind", "low", "high", "bins"},
    Operation.DATA_VISUALIZATION: set(),
}
# Steps that need no other row: they also run on a stream.
ROW_WISE = {
    Operation.STANDARDIZE_COLUMN_NAME,
    Operation.CONVERT_CASE,
    Operation.CHANGE_DATATYPE,
    Operation.FILTER_ROWS,
    Operation.DERIVE_COLUMN,
    Operation.RENAME_COLUMN,
    Operation.CONVERT_TO_DATETIME,
    Operation.CONVERT_TO_NUMERIC,
    Operation.FEATURE_ENGINEERING,
    Operation.DATA_VISUALIZATION,
}
NULL_STEPS = {Operation.HANDLE_NULLS, Operation.FILL_NULLS}


def is_row_wise(step: Step) -> bool:
    if step.operation_type in NULL_STEPS:
        alone = step.params.get("strategy", "fill_zero")
        return alone not in nulls.STATISTICS and alone not in nulls.ORDERED
    if step.params.get("errors") == "ignore" or step.params.get("decimal_separator") == "auto_detect":
        return False
    return step.operation_type in ROW_WISE


def _check(df: DataFrame, step: Step, column: str | None) -> None:
    if extra := set(step.params) - PARAMS[step.operation_type]:
        raise ValueError(f"{step.operation_type.value} does not take {sorted(extra)}")
    free = {Operation.FILTER_ROWS, Operation.AGGREGATE, Operation.DERIVE_COLUMN, Operation.DATA_VISUALIZATION}
    if step.operation_type in free or column == ALL:
        return
    if column is None and step.operation_type in (Operation.REMOVE_DUPLICATES, Operation.STANDARDIZE_COLUMN_NAME):
        return
    if column not in df.columns:
        raise ValueError(f"{step.operation_type.value}: no column {step.column_name!r}")


def _apply_step(df: DataFrame, step: Step, names: Names) -> DataFrame:
    op, p = step.operation_type, dict(step.params)
    column = names(step.column_name) if step.column_name else None
    _check(df, step, column)
    for key in ("by", "partition_by", "order_by", "subset"):
        if key in p:
            p[key] = [names(c) for c in p[key]]
    if op is Operation.STANDARDIZE_COLUMN_NAME:
        chosen = [c for c in df.columns if c != MARKS] if column in (None, ALL) else [column]
        out = cols.standardize_names(df, chosen, **p)
        names.follow(df.columns, out.columns)
        return out
    if op is Operation.RENAME_COLUMN:
        new = p.get("new_name") or style_name(column, "snake_case")
        out = cols.rename_columns(df, {column: new})
        names.follow(df.columns, out.columns)
        return out
    if op in NULL_STEPS:
        return nulls.handle_nulls(df, column, **p)
    if op is Operation.CONVERT_CASE:
        return texts.convert_case(df, [column], p.get("case", "lower"))
    if op is Operation.CHANGE_DATATYPE:
        return cols.change_datatype(df, {column: p["type"]}, p.get("errors", "coerce"))
    if op is Operation.FILTER_ROWS:
        return cols.filter_rows(df, p["condition"])
    if op is Operation.AGGREGATE:
        return ag.aggregate(df, p["by"], {names(c): f for c, f in p["what"].items()}, p.get("approx", False))
    if op is Operation.REMOVE_DUPLICATES:
        subset = p.pop("subset", None) or (None if column in (None, ALL) else [column])
        return dedup.remove_duplicates(df, subset, **p)
    if op is Operation.DERIVE_COLUMN:
        return cols.derive_column(df, step.column_name, p["expression"])
    if op is Operation.CONVERT_TO_DATETIME:
        return dates.to_datetime(df, column, **p)
    if op is Operation.CONVERT_TO_NUMERIC:
        return numeric.to_numeric(
            df,
            column,
            p.get("decimal_separator", "dot"),
            p.get("remove_currency", False),
            p.get("thousands"),
            p.get("errors", "coerce"),
        )
    if op is Operation.NORMALIZE:
        return numeric.normalize(df, [column], p.get("method", "standard"))
    if op is Operation.FEATURE_ENGINEERING:
        return cols.feature_columns(df, column, **p)
    return df  # a chart changes no data


def _joined_fills(steps: Sequence[Step]) -> list[list[Step]]:
    """Neighbouring statistic fills and normalisations of different columns, to be computed in one job."""
    groups: list[list[Step]] = []
    for step in steps:
        kind = _shared_kind(step)
        if groups and kind and _shared_kind(groups[-1][0]) == kind:
            if step.column_name not in {s.column_name for s in groups[-1]}:
                groups[-1].append(step)
                continue
        groups.append([step])
    return groups


def _shared_kind(step: Step) -> tuple | None:
    p = step.params
    if step.operation_type in NULL_STEPS and p.get("strategy") in nulls.STATISTICS:
        return ("fill", tuple(p.get("by", ())), p.get("approx", False))
    if step.operation_type is Operation.NORMALIZE:
        return ("normalize", p.get("method", "standard"))
    return None


def apply_plan(df: DataFrame, plan: Plan) -> DataFrame:
    """Apply the steps in order. Steps name columns as they were at the start.

    Nothing runs but the plan's own output: statistics are scalar subqueries, and
    neighbouring statistic steps share one. (Grouped fills and ``ignore`` run a small job.)
    """
    names = Names(df.columns)
    for group in _joined_fills(plan.transformation_steps):
        df = _apply_group(df, group, names)
    return df


def _apply_group(df: DataFrame, group: Sequence[Step], names: Names) -> DataFrame:
    if len(group) == 1:
        return _apply_step(df, group[0], names)
    for step in group:
        _check(df, step, names(step.column_name))
    if group[0].operation_type is Operation.NORMALIZE:
        return numeric.normalize(df, [names(s.column_name) for s in group], group[0].params.get("method", "standard"))
    strategies = {names(s.column_name): s.params["strategy"] for s in group}
    by = [names(c) for c in group[0].params.get("by", ())]
    return nulls.fill_statistics(df, strategies, by, group[0].params.get("approx", False))


def keeps_rows(step: Step) -> bool:
    """True for a step after which the same rows are there."""
    if step.operation_type in NULL_STEPS:
        return step.params.get("strategy", "fill_zero") != "drop_rows"
    return step.operation_type not in (Operation.FILTER_ROWS, Operation.AGGREGATE, Operation.REMOVE_DUPLICATES)


# Missing marks that travel with the rows of a stage: before its first step and after each.
MARKS = "__marks"


def _marked(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """Add marks to those that the rows carry already."""
    own = F.array(*[v.cast("boolean") for v in values])
    return df.withColumn(MARKS, F.concat(F.col(MARKS), own) if MARKS in df.columns else own)


def apply_logged(df: DataFrame, plan: Plan) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The same, and the log: rows and missing cells of the step's column before and after each step.

    Steps that keep all rows form a stage with the step after which rows change. Within a stage every row carries marks
    of what was missing before and after each step, so the log takes one aggregation a stage, however many
    steps it has. The log does not depend on retried tasks or on an action on the result.
    """
    names = Names(df.columns)
    steps = plan.transformation_steps
    stages: list[DataFrame] = []
    # where the numbers of each step are: (stage, mark) before and after it
    places: list[tuple[tuple[int, int], tuple[int, int]]] = []
    logged, count = df, 0

    def mark(column: str) -> tuple[int, int]:
        nonlocal logged, count
        missing = st.present(logged, column).isNull() if column in logged.columns else F.lit(False)
        logged, count = _marked(logged, [missing]), count + 1
        return len(stages), count - 1

    for step in steps:
        before = mark(names(step.column_name or ALL))
        if not keeps_rows(step):
            # the next stage reads the plain rows: marks must not keep duplicates apart
            stages.append(logged)
            logged, count = _apply_step(logged.drop(MARKS), step, names), 0
        else:
            logged = _apply_step(logged, step, names)
        places.append((before, mark(names(step.column_name or ALL))))
    stages.append(logged)

    def log() -> DataFrame:
        if not steps:
            schema = "step int, operation string, column string, rows_before long, rows_after long, rows_removed long, cells_filled long"
            return df.sparkSession.createDataFrame([], schema)
        sizes = [max([0, *(m + 1 for pair in places for at, m in pair if at == i)]) for i in range(len(stages))]
        one = df.sparkSession.range(1)
        for i, (table, size) in enumerate(zip(stages, sizes)):
            counts = [F.count_if(F.col(MARKS)[j]).alias(f"m{j}") for j in range(size)]
            one = st.attach(one, table.agg(F.count(F.lit(1)).alias("rows"), *counts), f"s{i}")

        def number(place: tuple[int, int], field: str | None = None) -> Column:
            return F.col(f"s{place[0]}")[field or f"m{place[1]}"]

        rows = [
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(step.operation_type.value).alias("operation"),
                F.lit(step.column_name).cast("string").alias("column"),
                number(before, "rows").alias("rows_before"),
                number(after, "rows").alias("rows_after"),
                (number(before, "rows") - number(after, "rows")).alias("rows_removed"),
                (number(before) - number(after)).alias("cells_filled"),
            )
            for i, (step, (before, after)) in enumerate(zip(steps, places))
        ]
        return one.select(F.inline(F.array(*rows)))

    return logged.drop(MARKS), log
