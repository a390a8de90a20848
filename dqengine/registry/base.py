"""Registered queries and the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the dirty views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """The SQL with its table names bound to this folder's tables."""
        bound = {t: self.spark.read.parquet(f"{self.folder}/{t}.parquet") for t in SOURCES if t in text}
        for t in bound:
            text = text.replace(f"from {t}", f"from {{{t}}}")
        return self.spark.sql(text, **bound)


SOURCES = ("customer", "orders", "events")

# The dirty views: the same text is a view here and a CTE in the oracle.
VIEWS = {
    "dirty_customer": """
select c_custkey as id,
  case when c_custkey % 11 = 0 then null else c_acctbal end as acctbal,
  case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then 'N/A'
       when c_custkey % 13 = 0 then '--' else c_mktsegment end as segment,
  case when c_custkey % 3 = 0 then concat('  ', lower(c_name), '  x ')
       when c_custkey % 3 = 1 then upper(c_name) else 'São João' end as nome,
  cast(null as string) as vazio
from customer""",
    "dirty_orders": """
select o_orderkey as id, o_custkey as custkey, o_orderdate as dt,
  case when o_orderkey % 17 = 0 then 'invalid'
       when o_orderkey % 3 = 0 then concat(cast(year(o_orderdate) as string), '-',
         lpad(cast(month(o_orderdate) as string), 2, '0'), '-',
         lpad(cast(day(o_orderdate) as string), 2, '0'))
       else concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '/',
         lpad(cast(month(o_orderdate) as string), 2, '0'), '/',
         cast(year(o_orderdate) as string)) end as data_txt,
  case when o_orderkey % 19 = 0 then null
       else concat('R$ ', cast(cast(floor(cents / 100000) as bigint) as string), '.',
         lpad(cast(cast(floor(cents / 100) as bigint) % 1000 as string), 3, '0'), ',',
         lpad(cast(cents % 100 as string), 2, '0')) end as valor_txt,
  cents
from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders) t""",
    "dup_events": """
select event_id, user_id, event_type, value, ts from events
union all
select event_id, user_id, event_type, value, ts from events where event_id % 10 = 0""",
    "gappy_events": """
select event_id, user_id, ts,
  case when event_id % 4 = 0 then null else value end as value
from events""",
}


def with_views(sql: str) -> str:
    """The oracle with the dirty views it names put in front as CTEs."""
    used = [f"{name} as ({text})" for name, text in VIEWS.items() if name in sql]
    if not used:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(used) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(used) + ",\n" + body[5:]
    return "with " + ",\n".join(used) + "\n" + body


def query(name: str, covers: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``covers`` lists the survey's ids."""

    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return keep
