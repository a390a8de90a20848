"""Sources, profile, names, columns, gaps, numbers, dates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from dqengine.functions import dates as dt
from dqengine.functions import names as nn
from dqengine.functions import numbers as nm
from dqengine.operators import columns as cols
from dqengine.operators import dates, nulls, numeric
from dqengine.operators import profile as pf
from dqengine.registry.base import query
from dqengine.session import scratch_path
from dqengine.sources import readers, sinks

# ---------------------------------------------------------------- sources

CSV_SQL = """select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, round(c_acctbal, 2) as c_acctbal,
  c_mktsegment from customer"""


def _written_csv(t, df, sep=","):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(df, path, sep=sep)
    return path


@query("read_csv", "S1", CSV_SQL)
def _(t):
    return readers.read_csv(t.spark, _written_csv(t, t.customer))


@query("read_csv_sniffed", "S1", CSV_SQL)
def _(t):
    return readers.read_csv(t.spark, _written_csv(t, t.customer, ";"))


@query(
    "read_csv_null_tokens",
    "S2",
    """select id, acctbal, case when segment = 'N/A' then null else segment end as segment, nome, vazio
         from dirty_customer""",
)
def _(t):
    return readers.read_csv(t.spark, _written_csv(t, t.dirty_customer, ";"))


@query(
    "read_csv_documents",
    "S1",
    "select doc_id, case when text in ('', 'NA', 'N/A', 'null') then null else text end as text, lang, source, n_chars from documents",
)
def _(t):
    # texts with commas, quotes and line breaks come back as they were
    return readers.read_csv(t.spark, _written_csv(t, t.documents))


@query(
    "null_tokens",
    "S2",
    "select id, case when segment = 'N/A' then null else segment end as segment from dirty_customer",
)
def _(t):
    return nulls.null_tokens(t.dirty_customer).select("id", "segment")


@query(
    "read_json",
    "S3",
    "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) as o_totalprice from orders",
)
def _(t):
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.orders.drop("o_orderdate"), path)
    return readers.read_json(t.spark, path, multiline=False)


@query(
    "read_json_array",
    "S3",
    """select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) as o_totalprice,
         {'key': o_orderkey, 'note': 'a "}" or ]'} as more from orders""",
)
def _(t):
    # files of one array each, with texts that hold brackets
    path = scratch_path(t.spark, "arrays")
    more = F.struct(F.col("o_orderkey").alias("key"), F.lit('a "}" or ]').alias("note")).alias("more")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"), more)
    files = rows.select(F.floor(F.col("o_orderkey") / 20_000).alias("file"), F.to_json(F.struct("*")).alias("value"))
    # a task for about five files, however many there are
    files = files.repartition(t.orders.count() // 100_000 + 1, "file")
    arrays = files.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return readers.read_json(t.spark, path)


@query(
    "read_source",
    "S4",
    "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice from part",
)
def _(t):
    path = scratch_path(t.spark, "source")
    sinks.write_json(t.part, path)
    return readers.read_source(t.spark, path, "json_lines")


@query(
    "load_report",
    "S5",
    """with cells as (select unnest([{'c': 'data_txt', 'v': data_txt}, {'c': 'valor_txt', 'v': valor_txt}], recursive := true) from dirty_orders),
       kinds as (
         select distinct c, case when regexp_matches(v, '^[+-]?[0-9]+$') then 'int' when regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') then 'double'
           when regexp_matches(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?|[0-9]{2}/[0-9]{2}/[0-9]{4})$') then 'date'
           when lower(v) in ('true', 'false') then 'bool' else 'string' end as kind from cells where v not in ('', 'NULL', 'null', 'NaN', 'nan', 'N/A', '#N/A')),
       mixed as (select c from kinds group by c having count(*) > 1)
       select 'default' as method_used, coalesce('mixed types: ' || string_agg(c, ', ' order by c), '') as warnings from mixed""",
)
def _(t):
    loaded = readers.load_csv(t.spark, _written_csv(t, t.dirty_orders.select("id", "data_txt", "valor_txt")))
    return readers.load_report(loaded.df, loaded.method)


@query(
    "write_parquet",
    "S6",
    "select event_type, count(*) as n, round(sum(value), 6) as total from dup_events group by event_type",
)
def _(t):
    path = scratch_path(t.spark, "parquet")
    sinks.write_parquet(t.dup_events, path, partition_by=["event_type"])
    back = t.spark.read.parquet(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("corpus_store", "S7", "select doc_id as chunk_id, source, lang as category, length(text) as n from documents")
def _(t):
    from dqengine.operators.retrieval import corpus

    def build():
        return corpus(t.documents, "doc_id", "text", F.col("source"), F.col("source"), F.col("lang"))

    stored = readers.load_corpus(t.spark, scratch_path(t.spark, "corpus"), build)
    return stored.select("chunk_id", "source", "category", F.length("content").cast("bigint").alias("n"))


# ---------------------------------------------------------------- profile


@query("table_shape", "P1", "select count(*) as num_rows, cast(11 as bigint) as num_columns from lineitem")
def _(t):
    return pf.table_shape(t.lineitem)


def _profile_sql(column: str, dtype: str, ranged: bool, text: bool = False) -> str:
    lo, hi = (f"cast(min({column}) as varchar)", f"cast(max({column}) as varchar)") if ranged else ("null", "null")
    shown = "true" if text else f"count(distinct {column}) < 50"
    return (
        f"select '{column}' as name, '{dtype}' as dtype, count(*) > count({column}) as is_nullable, "
        f"case when {shown} then count(distinct {column}) end as unique_values, "
        f"{lo} as min_value, {hi} as max_value from dirty_customer"
    )


@query(
    "profile_columns",
    "P2 P3 P4 P6",
    " union all ".join(
        [
            _profile_sql("id", "bigint", True),
            _profile_sql("acctbal", "double", True),
            _profile_sql("segment", "string", False, True),
            _profile_sql("nome", "string", False, True),
            _profile_sql("vazio", "string", False, True),
        ]
    ),
)
def _(t):
    return pf.profile(t.dirty_customer).select(
        "name", "dtype", "is_nullable", "unique_values", "min_value", "max_value"
    )


@query(
    "profile_dtypes",
    "P2",
    """select column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
         when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end as dtype,
         n as n_rows from (describe lineitem) d, (select count(*) as n from lineitem) c""",
)
def _(t):
    return pf.observed(t.lineitem).select("name", "dtype", "n_rows")


@query(
    "profile_missing",
    "P3",
    """select 'acctbal' as name, count(*) > count(acctbal) as is_nullable from dirty_customer
       union all select 'id', count(*) > count(id) from dirty_customer
       union all select 'nome', count(*) > count(nome) from dirty_customer
       union all select 'segment', count(*) > count(segment) from dirty_customer
       union all select 'vazio', count(*) > count(vazio) from dirty_customer""",
)
def _(t):
    return pf.observed(t.dirty_customer).select("name", (F.col("n_missing") > 0).alias("is_nullable"))


@query(
    "profile_unique",
    "P4",
    """select 'c_custkey' as name, count(distinct c_custkey) as n from customer
       union all select 'c_name', count(distinct c_name) from customer
       union all select 'c_nationkey', count(distinct c_nationkey) from customer
       union all select 'c_acctbal', count(distinct c_acctbal) from customer
       union all select 'c_mktsegment', count(distinct c_mktsegment) from customer""",
)
def _(t):
    counts = pf.value_table(t.customer).groupBy("column").agg(F.count("value").alias("n"))
    return counts.withColumnRenamed("column", "name")


@query(
    "top_values",
    "P5",
    """with v as (select 'segment' as "column", coalesce(segment, 'nan') as value from dirty_customer
         union all select 'nome', coalesce(nome, 'nan') from dirty_customer),
       c as (select "column", value, count(*) as count from v group by all)
       select "column", value, count, row_number() over (partition by "column" order by count desc, value) as rank
       from c qualify row_number() over (partition by "column" order by count desc, value) <= 5""",
)
def _(t):
    top = pf.top_values(t.dirty_customer, 5, ["segment", "nome"])
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "profile_range",
    "P6",
    """select 'event_id' as name, cast(min(event_id) as varchar) as min_value, cast(max(event_id) as varchar) as max_value from events
       union all select 'ts', cast(min(ts) as varchar), cast(max(ts) as varchar) from events
       union all select 'user_id', cast(min(user_id) as varchar), cast(max(user_id) as varchar) from events
       union all select 'value', cast(min(value) + 0.0 as varchar), cast(max(value) as varchar) from events
       union all select 'event_type', null, null union all select 'props', null, null""",
)
def _(t):
    return pf.observed(t.events).select("name", "min_value", "max_value")


@query(
    "mixed_types",
    "P7",
    """with v as (select distinct data_txt as v from dirty_orders where data_txt is not null),
       k as (select v, case when regexp_matches(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$') then 'date' else 'string' end as kind from v)
       select 'data_txt' as "column", (select string_agg(distinct kind, ',' order by kind) from k) as types,
         (select string_agg(v, '|' order by v) from (select v from v order by v limit 3)) as sample_values""",
)
def _(t):
    return pf.mixed_types(t.dirty_orders)


@query(
    "missing_cells",
    "P8",
    """select sum((acctbal is null)::int + (segment is null)::int + (nome is null)::int + (vazio is null)::int)::bigint
       as missing_cells from dirty_customer""",
)
def _(t):
    return pf.missing_cells(t.dirty_customer)


@query(
    "missing_rate",
    "P9",
    """select 'id' as "column", 0.0::double as rate
       union all select 'acctbal', round(avg((acctbal is null)::int), 6) from dirty_customer
       union all select 'segment', round(avg((segment is null)::int), 6) from dirty_customer
       union all select 'nome', round(avg((nome is null)::int), 6) from dirty_customer
       union all select 'vazio', round(avg((vazio is null)::int), 6) from dirty_customer""",
)
def _(t):
    return pf.missing_rate(t.dirty_customer).withColumn("rate", F.round("rate", 6))


@query(
    "run_summary",
    "P10",
    """with a as (select distinct * from dup_events)
       select (select count(*) from dup_events) as original_rows, 5::bigint as original_columns,
         (select count(*) from a) as final_rows, 5::bigint as final_columns,
         (select count(*) from dup_events) - (select count(*) from a) as rows_changed, 0::bigint as columns_changed,
         0::bigint as missing_before, 0::bigint as missing_after""",
)
def _(t):
    return pf.run_summary(t.dup_events, t.dup_events.dropDuplicates())


def _flags_sql() -> str:
    parts = []
    for name, terms in pf.KEYWORD_GROUPS.items():
        test = " or ".join(f"contains(lower(text), '{term}')" for term in terms)
        parts.append(f"({test}) as {name}")
    return f"select doc_id, {', '.join(parts)} from documents"


@query("keyword_flags", "P11", _flags_sql())
def _(t):
    return pf.keyword_flags(t.documents.select("doc_id", "text"), "text").drop("text")


QUANTILE_SQL = """with q as (select unnest([0.25, 0.5, 0.75]) as prob)
  select 'l_extendedprice' as "column", prob::double as prob,
    round(case prob when 0.25 then (select quantile_cont(l_extendedprice, 0.25) from lineitem)
      when 0.5 then (select quantile_cont(l_extendedprice, 0.5) from lineitem)
      else (select quantile_cont(l_extendedprice, 0.75) from lineitem) end, 6) as value from q
  union all select 'l_quantity', prob::double,
    round(case prob when 0.25 then (select quantile_cont(l_quantity, 0.25) from lineitem)
      when 0.5 then (select quantile_cont(l_quantity, 0.5) from lineitem)
      else (select quantile_cont(l_quantity, 0.75) from lineitem) end, 6) from q"""


@query("describe_quantiles", "P12", QUANTILE_SQL)
def _(t):
    out = pf.describe_quantiles(t.lineitem, ["l_extendedprice", "l_quantity"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "describe",
    "P12",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
        min({c})::double as min, max({c})::double as max from lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(t):
    out = pf.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# ---------------------------------------------------------------- names

# SQL for snake case of an expression, in the same order of replacements.


def _snake_sql(c: str) -> str:
    out = f"lower({c})"
    for word in nn.JOINING_WORDS:
        out = f"replace({out}, '{word}', '_')"
    for ch in nn.TO_UNDERSCORE:
        out = f"replace({out}, '{ch}', '_')"
    for ch in nn.DROPPED:
        out = f"replace({out}, '{ch}', '')"
    return f"trim(regexp_replace({out}, '_+', '_', 'g'), '_')"


NAME_AS_DATA = "concat(p_name, ' - ', p_type, ' (', p_brand, ')')"


@query(
    "snake_case",
    "N1",
    f"select p_partkey, {_snake_sql(NAME_AS_DATA)} as name from part",
)
def _(t):
    return t.part.select("p_partkey", nn.snake_case(F.expr(NAME_AS_DATA)).alias("name"))


@query(
    "standardize_names",
    "N1",
    """select id as regiao_sigla, data_txt as data_coleta, valor_txt as "valor_venda_r$", cents as "valor_venda_r$_2"
       from dirty_orders""",
)
def _(t):
    odd = t.dirty_orders.select(
        F.col("id").alias("Regiao - Sigla"),
        F.col("data_txt").alias("Data da Coleta"),
        F.col("valor_txt").alias("Valor de Venda (R$)"),
        F.col("cents").alias("valor-venda-R$"),
    )
    return cols.standardize_names(odd)


@query(
    "needs_standardizing",
    "N2",
    """select p_partkey, regexp_matches(p_name, '[ \\-()/\\\\.:]') as name_odd,
       regexp_matches(p_brand, '[ \\-()/\\\\.:]') as brand_odd from part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        nn.needs_standardizing(F.col("p_name")).alias("name_odd"),
        nn.needs_standardizing(F.col("p_brand")).alias("brand_odd"),
    )


@query(
    "name_styles",
    "N3",
    """with w as (select p_partkey, list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '') as w from part),
       p as (select p_partkey, w, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') as pascal from w)
       select p_partkey, array_to_string(w, '-') as kebab, pascal, lower(pascal[1]) || pascal[2:] as camel from p""",
)
def _(t):
    name = F.concat_ws(" ", "p_name", "p_brand")
    return t.part.select(
        "p_partkey",
        nn.style_case(name, "kebab-case").alias("kebab"),
        nn.style_case(name, "PascalCase").alias("pascal"),
        nn.style_case(name, "camelCase").alias("camel"),
    )


@query(
    "clean_names",
    "N4",
    """select id, regexp_replace(regexp_replace(strip_accents(nome), '\\s+', '', 'g'), '[^A-Za-z0-9_ ]', '', 'g') as nome
       from dirty_customer""",
)
def _(t):
    return t.dirty_customer.select("id", nn.clean_name(F.col("nome")).alias("nome"))


@query("rename_columns", "N5", "select n_nationkey as id, n_name as nation, n_regionkey as region from nation")
def _(t):
    return cols.rename_columns(t.nation, {"n_nationkey": "id", "n_name": "nation", "n_regionkey": "region"})


# ---------------------------------------------------------------- columns


@query(
    "filter_rows",
    "C1",
    "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'",
)
def _(t):
    return cols.filter_rows(t.orders, "o_totalprice > 100000 and o_orderstatus = 'F'").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "derive_column",
    "C2",
    """select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
       from lineitem group by l_returnflag""",
)
def _(t):
    lines = cols.derive_column(t.lineitem, "revenue", "l_extendedprice * (1 - l_discount)")
    return lines.groupBy("l_returnflag").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


@query(
    "feature_columns",
    "C3",
    """select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month,
         day(o_orderdate)::int as o_orderdate_day, (dayofweek(o_orderdate) + 1)::int as o_orderdate_dayofweek,
         (case when o_totalprice < 0 then 0 when o_totalprice >= 500000 then 11
           else floor(o_totalprice / 50000) + 1 end)::bigint as o_totalprice_bin,
         length(o_orderpriority)::int as o_orderpriority_length from orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    df = cols.feature_columns(df, "o_orderdate", "date_parts")
    df = cols.feature_columns(df, "o_totalprice", "bins", 0, 500000, 10)
    df = cols.feature_columns(df, "o_orderpriority", "text_length")
    return df.drop("o_orderdate", "o_totalprice", "o_orderpriority")


@query(
    "change_datatype",
    "C4",
    """select id, try_cast(split_part(o_orderpriority, '-', 1) as int) as level, try_cast(data_txt as date) as day
       from (select d.id, d.data_txt, o.o_orderpriority from dirty_orders d join orders o on d.id = o.o_orderkey)""",
)
def _(t):
    df = t.dirty_orders.join(t.orders, F.col("id") == F.col("o_orderkey"))
    df = df.select("id", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"), F.col("data_txt").alias("day"))
    return cols.change_datatype(df, {"level": "int", "day": "date"})


@query("drop_sparse_columns", "C5", "select id, acctbal, segment, nome from dirty_customer")
def _(t):
    return cols.drop_sparse_columns(t.dirty_customer)


@query("drop_empty_columns", "C6", "select id, acctbal, segment, nome, 'x' as same from dirty_customer")
def _(t):
    return cols.drop_empty_columns(t.dirty_customer.withColumn("same", F.lit("x")))


@query("drop_constant_columns", "C6", "select id, acctbal, segment, nome from dirty_customer")
def _(t):
    return cols.drop_constant_columns(t.dirty_customer.withColumn("same", F.lit("x")))


@query("drop_duplicate_columns", "C7", "select event_id, user_id, value from events")
def _(t):
    df = t.events.select("event_id", "user_id", "value")
    return cols.drop_duplicate_columns(df.withColumns({"copy": F.col("user_id"), "near": F.col("value")}))


@query(
    "optimize_types",
    "C8",
    """select 'l_orderkey' as "column", case when max(l_orderkey) < 128 then 'tinyint' when max(l_orderkey) < 32768 then 'smallint' else 'int' end as proposed from lineitem
       union all select 'l_partkey', case when max(l_partkey) < 128 then 'tinyint' when max(l_partkey) < 32768 then 'smallint' else 'int' end from lineitem
       union all select 'l_suppkey', case when max(l_suppkey) < 128 then 'tinyint' when max(l_suppkey) < 32768 then 'smallint' else 'int' end from lineitem
       union all select 'l_linenumber', case when max(l_linenumber) < 128 then 'tinyint' else 'smallint' end from lineitem
       union all select 'l_quantity', case when bool_and(l_quantity = floor(l_quantity)) then 'bigint' else 'double' end from lineitem
       union all select 'l_extendedprice', case when bool_and(l_extendedprice = floor(l_extendedprice)) then 'bigint' else 'double' end from lineitem
       union all select 'l_discount', 'double' union all select 'l_tax', 'double'
       union all select 'l_returnflag', case when count(distinct l_returnflag) < 50 then 'category' else 'string' end from lineitem
       union all select 'l_linestatus', case when count(distinct l_linestatus) < 50 then 'category' else 'string' end from lineitem
       union all select 'l_shipdate', 'timestamp_ntz'""",
)
def _(t):
    return cols.fitting_types(t.lineitem).select("column", "proposed")


@query(
    "infer_types",
    "C9",
    """select 'data_txt' as "column", count(data_txt) as n_values,
         round(avg((data_txt <> 'invalid')::int), 6) as share_date,
         case when avg((data_txt <> 'invalid')::int) >= 0.9 then 'timestamp' else 'string' end as proposed from dirty_orders
       union all select 'valor_txt', count(valor_txt), 0.0, 'string' from dirty_orders""",
)
def _(t):
    return cols.infer_types(t.dirty_orders).select(
        "column", "n_values", F.round("share_date", 6).alias("share_date"), "proposed"
    )


@query(
    "column_type_groups",
    "C10",
    """select p_partkey, p_name as name, p_dtype as dtype, p_dtype in ('bigint', 'double') as is_number,
         p_dtype = 'string' and regexp_matches(p_name, 'data|date|time|created|updated') as is_date_like,
         p_dtype = 'string' and regexp_matches(p_name, 'valor|price|preco|cost|amount|money') as is_money_like
       from (select p_partkey, lower(p_name || case p_partkey % 3 when 0 then ' price' when 1 then ' date' else '' end) as p_name,
         case p_partkey % 4 when 0 then 'bigint' when 1 then 'double' else 'string' end as p_dtype from part)""",
)
def _(t):
    names = t.part.selectExpr(
        "p_partkey",
        "lower(p_name || case p_partkey % 3 when 0 then ' price' when 1 then ' date' else '' end) as name",
        "case p_partkey % 4 when 0 then 'bigint' when 1 then 'double' else 'string' end as dtype",
    )
    return cols.column_type_groups(names)


# ---------------------------------------------------------------- gaps


@query("fill_zero", "H1", "select id, coalesce(acctbal, 0) as acctbal from dirty_customer")
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "acctbal").select("id", "acctbal")


@query("fill_custom", "H2", "select id, coalesce(segment, 'N/A') as segment from dirty_customer")
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "segment", "fill_custom").select("id", "segment")


@query(
    "fill_mean",
    "H3",
    "select id, round(coalesce(acctbal, (select avg(acctbal) from dirty_customer)), 6) as acctbal from dirty_customer",
)
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "acctbal", "fill_mean").select("id", F.round("acctbal", 6).alias("acctbal"))


@query(
    "fill_median",
    "H4",
    "select id, round(coalesce(acctbal, (select median(acctbal) from dirty_customer)), 6) as acctbal from dirty_customer",
)
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "acctbal", "fill_median").select("id", F.round("acctbal", 6).alias("acctbal"))


@query(
    "fill_mode",
    "H5",
    """with m as (select segment from dirty_customer where segment is not null group by segment
         order by count(*) desc, segment limit 1)
       select id, coalesce(segment, (select segment from m)) as segment from dirty_customer""",
)
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "segment", "fill_mode").select("id", "segment")


@query("drop_missing_rows", "H6", "select id, segment from dirty_customer where segment is not null")
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "segment", "drop_rows").select("id", "segment")


@query("fill_unknown_strategy", "H7", "select id, coalesce(segment, 'N/A') as segment from dirty_customer")
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "segment", "no_such_strategy").select("id", "segment")


@query(
    "fill_forward",
    "H8",
    """select event_id, last_value(value ignore nulls) over (partition by user_id order by ts, event_id
         rows between unbounded preceding and current row) as value from gappy_events""",
)
def _(t):
    out = nulls.handle_nulls(
        t.gappy_events, "value", "fill_forward", partition_by=["user_id"], order_by=["ts", "event_id"]
    )
    return out.select("event_id", "value")


@query(
    "fill_forward_whole",
    "H8",
    """select event_id, last_value(value ignore nulls) over (order by ts, event_id
         rows between unbounded preceding and current row) as value from gappy_events""",
)
def _(t):
    return nulls.handle_nulls(t.gappy_events, "value", "fill_forward", order_by=["ts", "event_id"]).select(
        "event_id", "value"
    )


@query(
    "fill_forward_limit",
    "H8",
    """with r as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from
         (select event_id, user_id, ts, case when event_id % 4 < 3 then null else value end as value from gappy_events)),
       s as (select *, max(case when value is not null then rn end) over w as last_at, last_value(value ignore nulls) over w as seen
         from r window w as (partition by user_id order by rn rows between unbounded preceding and current row))
       select event_id, case when rn - last_at <= 2 then seen end as value from s""",
)
def _(t):
    wider = t.gappy_events.withColumn("value", F.expr("case when event_id % 4 < 3 then null else value end"))
    out = nulls.fill_ordered(wider, "value", "fill_forward", ["ts", "event_id"], ["user_id"], limit=2)
    return out.select("event_id", "value")


@query(
    "fill_backward",
    "H9",
    """select event_id, first_value(value ignore nulls) over (partition by user_id order by ts, event_id
         rows between current row and unbounded following) as value from gappy_events""",
)
def _(t):
    out = nulls.handle_nulls(
        t.gappy_events, "value", "fill_backward", partition_by=["user_id"], order_by=["ts", "event_id"]
    )
    return out.select("event_id", "value")


@query("keep_as_null", "H10", "select id, segment from dirty_customer")
def _(t):
    return nulls.handle_nulls(t.dirty_customer, "segment", "keep_as_null").select("id", "segment")


@query(
    "fill_by_group",
    "H11",
    """with m as (select segment, avg(acctbal) as a, median(acctbal) as d from dirty_customer group by segment)
       select c.id, round(coalesce(c.acctbal, m.a), 6) as mean_filled, round(coalesce(c.acctbal, m.d), 6) as median_filled
       from dirty_customer c join m on c.segment is not distinct from m.segment""",
)
def _(t):
    df = t.dirty_customer.select("id", "segment", F.col("acctbal").alias("mean_filled"), F.col("acctbal").alias("median_filled"))
    out = nulls.fill_statistics(df, {"mean_filled": "fill_mean", "median_filled": "fill_median"}, ["segment"])
    return out.select("id", F.round("mean_filled", 6).alias("mean_filled"), F.round("median_filled", 6).alias("median_filled"))


@query(
    "fill_mode_by_group",
    "H11",
    """with k as (select *, id % 10 as g from dirty_customer),
       n as (select g, segment, row_number() over (partition by g order by count(*) desc, segment) as r
         from k where segment is not null group by g, segment)
       select k.id, coalesce(k.segment, n.segment) as segment from k left join n on k.g = n.g and n.r = 1""",
)
def _(t):
    df = t.dirty_customer.select("id", "segment", (F.col("id") % 10).alias("g"))
    return nulls.handle_nulls(df, "segment", "fill_mode", by=["g"]).select("id", "segment")


@query(
    "normalize_nulls",
    "H12",
    """select id, case when upper(segment) in ('N/A', 'NULL', '--') then null else segment end as segment,
       case when cents = 999999 then null else cents end as cents
       from dirty_customer join (select id as oid, cents from dirty_orders) o on id = oid""",
)
def _(t):
    df = t.dirty_customer.join(t.dirty_orders.select("id", "cents"), "id").select("id", "segment", "cents")
    return nulls.normalize_nulls(df, columns=["segment", "cents"])


@query(
    "fill_nulls",
    "H13",
    "select id, coalesce(acctbal, -1) as acctbal, coalesce(segment, 'none') as segment, coalesce(vazio, '') as vazio from dirty_customer",
)
def _(t):
    return nulls.fill_nulls(t.dirty_customer, {"acctbal": -1.0, "segment": "none", "vazio": ""}).drop("nome")


# ---------------------------------------------------------------- numbers

LOCAL_NUMBER = """try_cast(replace(replace(regexp_replace(valor_txt, '[R$€£¥₹\\s]', '', 'g'), '.', ''), ',', '.') as double)"""


@query("to_numeric", "M1", f"select id, {LOCAL_NUMBER} as valor from dirty_orders")
def _(t):
    out = numeric.to_numeric(t.dirty_orders, "valor_txt", "comma", True, ".")
    return out.select("id", F.col("valor_txt").alias("valor"))


@query(
    "strip_currency",
    "M2",
    "select id, regexp_replace(valor_txt, '[R$€£¥₹]', '', 'g') as valor from dirty_orders",
)
def _(t):
    return t.dirty_orders.select("id", nm.strip_currency(F.col("valor_txt")).alias("valor"))


@query("decimal_comma", "M3", "select id, replace(valor_txt, ',', '.') as valor from dirty_orders")
def _(t):
    return t.dirty_orders.select("id", nm.decimal_comma(F.col("valor_txt")).alias("valor"))


@query(
    "strip_thousands",
    "M4",
    """select id, replace(valor_txt, '.', '') as dots, replace(replace(valor_txt, '.', ','), ',', '') as commas,
         regexp_replace(replace(valor_txt, '.', ' '), '[ ]+', '', 'g') as spaces from dirty_orders""",
)
def _(t):
    v = F.col("valor_txt")
    return t.dirty_orders.select(
        "id",
        nm.strip_thousands(v, ".").alias("dots"),
        nm.strip_thousands(F.replace(v, F.lit("."), F.lit(",")), ",").alias("commas"),
        nm.strip_thousands(F.replace(v, F.lit("."), F.lit(" ")), " ").alias("spaces"),
    )


@query(
    "detect_decimal",
    "M5",
    """with c as (
         select regexp_replace(valor_txt, '[^0-9.,+-]', '', 'g') as v from dirty_orders),
       n as (
         select count(*) filter (regexp_matches(v, '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?[.][0-9]+$')) as n_dot,
           count(*) filter (regexp_matches(v, '^[+-]?([0-9]{1,3}([.][0-9]{3})+|[0-9]+)?,[0-9]+$')) as n_comma from c)
       select *, case when n_comma > n_dot then 'comma' else 'dot' end as decimal from n""",
)
def _(t):
    return numeric.detect_decimal(t.dirty_orders, "valor_txt")


@query("to_numeric_auto", "M5", f"select id, {LOCAL_NUMBER} as valor from dirty_orders")
def _(t):
    out = numeric.to_numeric(t.dirty_orders, "valor_txt", "auto_detect", True, "auto")
    return out.select("id", F.col("valor_txt").alias("valor"))


LINE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(
    "round_places",
    "M6",
    f"select {LINE_ORDER}, round(l_extendedprice / 7, 3) as price from lineitem",
)
def _(t):
    df = t.lineitem.selectExpr(*LINE_ORDER.split(", "), "l_extendedprice / 7 as price")
    return numeric.round_places(df, ["price"], 3)


@query(
    "normalize_standard",
    "M7",
    f"""with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as d, avg(l_extendedprice) as pm,
         stddev_pop(l_extendedprice) as pd from lineitem)
       select {LINE_ORDER}, round((l_quantity - m) / d, 6) as l_quantity, round((l_extendedprice - pm) / pd, 6) as l_extendedprice
       from lineitem, s""",
)
def _(t):
    df = t.lineitem.select(*LINE_ORDER.split(", "), "l_quantity", "l_extendedprice")
    out = numeric.normalize(df, ["l_quantity", "l_extendedprice"])
    return numeric.round_places(out, ["l_quantity", "l_extendedprice"], 6)


@query(
    "normalize_minmax",
    "M8",
    f"""with s as (select min(l_quantity) as lo, max(l_quantity) as hi, min(l_extendedprice) as plo, max(l_extendedprice) as phi from lineitem)
       select {LINE_ORDER}, round((l_quantity - lo) / (hi - lo), 6) as l_quantity,
         round((l_extendedprice - plo) / (phi - plo), 6) as l_extendedprice from lineitem, s""",
)
def _(t):
    df = t.lineitem.select(*LINE_ORDER.split(", "), "l_quantity", "l_extendedprice")
    out = numeric.normalize(df, ["l_quantity", "l_extendedprice"], "minmax")
    return numeric.round_places(out, ["l_quantity", "l_extendedprice"], 6)


FENCES = """with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem),
  f as (select a - 0.2 * (b - a) as lo, b + 0.2 * (b - a) as hi from q)"""


@query(
    "outliers_iqr",
    "M9",
    f"{FENCES} select {LINE_ORDER}, (l_extendedprice < lo or l_extendedprice > hi) as l_extendedprice_outlier from lineitem, f",
)
def _(t):
    out = numeric.outliers_iqr(t.lineitem, ["l_extendedprice"], k=0.2)
    return out.select(*LINE_ORDER.split(", "), "l_extendedprice_outlier")


@query(
    "outliers_clip",
    "M9",
    f"""{FENCES} select l_returnflag, round(sum(least(greatest(l_extendedprice, lo), hi)), 2) as clipped,
      sum((l_extendedprice between lo and hi)::int)::bigint as kept from lineitem, f group by l_returnflag""",
)
def _(t):
    df = t.lineitem.select("l_returnflag", "l_extendedprice", F.col("l_extendedprice").alias("raw"))
    clipped = numeric.outliers_iqr(df, ["l_extendedprice"], 0.2, "clip")
    kept = numeric.outliers_iqr(clipped, ["raw"], 0.2, "null")
    return kept.groupBy("l_returnflag").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("clipped"), F.count("raw").alias("kept")
    )


@query(
    "outliers_zscore",
    "M10",
    f"""with s as (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as d from lineitem)
       select {LINE_ORDER}, l_extendedprice from lineitem, s where abs(l_extendedprice - m) <= 1.7 * d""",
)
def _(t):
    out = numeric.outliers_zscore(t.lineitem, ["l_extendedprice"], 1.7, "drop")
    return out.select(*LINE_ORDER.split(", "), "l_extendedprice")


@query("convert_unit", "M11", "select id, round(cents * 0.01::double, 2) as cents from dirty_orders")
def _(t):
    out = numeric.convert_unit(t.dirty_orders.select("id", "cents"), "cents", 0.01)
    return numeric.round_places(out, ["cents"], 2)


@query(
    "scale_check",
    "M11",
    """with v as (select case when id % 5 = 0 then 'cents' else 'whole' end as kind, case when id % 5 = 0 then cents * 1.0 else cents / 100.0 end as amount from dirty_orders),
       g as (select kind, median(amount) as median from v group by kind),
       o as (select median(amount) as overall from v)
       select kind, round(median, 6) as median, round(overall, 6) as overall, round(log10(median / overall))::int as power,
         round(log10(median / overall))::int <> 0 as suspicious from g, o""",
)
def _(t):
    df = t.dirty_orders.selectExpr(
        "case when id % 5 = 0 then 'cents' else 'whole' end as kind",
        "case when id % 5 = 0 then cast(cents as double) else cents / 100D end as amount",
    )
    return numeric.round_places(numeric.scale_check(df, "amount", ["kind"]), ["median", "overall"], 6)


# ---------------------------------------------------------------- dates

AUTO_SQL = "coalesce(try_strptime(data_txt, '%d/%m/%Y'), try_strptime(data_txt, '%Y-%m-%d'))"


@query("to_datetime", "D1", f"select id, {AUTO_SQL} as day from dirty_orders")
def _(t):
    return dates.to_datetime(t.dirty_orders, "data_txt").select("id", F.col("data_txt").alias("day"))


@query(
    "to_datetime_spelled",
    "D1",
    "select o_orderkey, o_orderdate::timestamp as named, o_orderdate::timestamp as short from orders",
)
def _(t):
    # month names and years of two digits
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "d MMM yyyy").alias("named"), F.date_format("o_orderdate", "dd/MM/yy").alias("short"))
    return dates.to_datetime(dates.to_datetime(df, "named"), "short")


@query("to_datetime_br", "D2", "select id, try_strptime(data_txt, '%d/%m/%Y') as day from dirty_orders")
def _(t):
    return dates.to_datetime(t.dirty_orders, "data_txt", "br_format").select("id", F.col("data_txt").alias("day"))


@query("to_datetime_iso", "D3", "select id, try_strptime(data_txt, '%Y-%m-%d') as day from dirty_orders")
def _(t):
    return dates.to_datetime(t.dirty_orders, "data_txt", "iso_format").select("id", F.col("data_txt").alias("day"))


@query(
    "to_datetime_us",
    "D4",
    "select o_orderkey, try_strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') as day from orders",
)
def _(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return dates.to_datetime(df, "day", "us_format")


@query(
    "detect_date_format",
    "D5",
    """with c as (
         select count(try_strptime(data_txt, '%d/%m/%Y')) as n_br, count(try_strptime(data_txt, '%Y-%m-%d')) as n_iso,
           count(try_strptime(data_txt, '%m/%d/%Y')) as n_us,
           count(case when try_strptime(data_txt, '%d/%m/%Y') is not null then try_strptime(data_txt, '%m/%d/%Y') end) as n_ambiguous,
           count(data_txt) as n_values from dirty_orders)
       select *, case when greatest(n_br, n_iso, n_us) = 0 then 'none' when n_br >= greatest(n_iso, n_us) then 'br_format'
         when n_iso >= n_us then 'iso_format' else 'us_format' end as format from c""",
)
def _(t):
    return dates.detect_date_format(t.dirty_orders, "data_txt")


@query(
    "format_dates",
    "D6",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%m/%d/%Y') as us,
         strftime(o_orderdate, '%d/%m/%Y') as br from orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", *[F.col("o_orderdate").alias(s) for s in dt.STYLES])
    for style in dt.STYLES:
        df = dates.format_dates(df, [style], style)
    return df


@query("invalid_dates_drop", "D7", f"select id, {AUTO_SQL} as day from dirty_orders where data_txt <> 'invalid'")
def _(t):
    return dates.invalid_dates(t.dirty_orders, "data_txt").select("id", F.col("data_txt").alias("day"))


@query(
    "invalid_dates_fill",
    "D7",
    f"select id, coalesce({AUTO_SQL}, timestamp '2024-02-29') as today, coalesce({AUTO_SQL}, timestamp '1900-01-01') as custom from dirty_orders",
)
def _(t):
    df = t.dirty_orders.select("id", F.col("data_txt").alias("today"), F.col("data_txt").alias("custom"))
    df = dates.invalid_dates(df, "today", "fill_today", today=datetime.date(2024, 2, 29))
    return dates.invalid_dates(df, "custom", "fill_custom", "1900-01-01")
