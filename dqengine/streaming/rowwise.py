"""Plans on a stream: the steps that look at one row at a time run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dqengine.plans.plan import Plan, apply_plan, is_row_wise


def apply_to_stream(df: DataFrame, plan: Plan) -> DataFrame:
    """Apply a plan to a streaming table; a step that needs other rows is an error."""
    wide = [s.operation_type.value for s in plan.transformation_steps if not is_row_wise(s)]
    if wide:
        raise ValueError(f"these steps need the whole table and do not run on a stream: {wide}")
    return apply_plan(df, plan)


def clean_to_parquet(df: DataFrame, plan: Plan, path: str, checkpoint: str) -> StreamingQuery:
    """Clean what has arrived and append it to a Parquet table, each row once."""
    return (
        apply_to_stream(df, plan)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
