"""Texts, duplicates, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.functions import text as tx
from dqengine.operators import aggregate as ag
from dqengine.operators import dedup, similar, texts
from dqengine.operators import textjobs as tj
from dqengine.registry.base import query

SPACE = "[ \\t\\n\\f\\r]"
TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+|[^\\p{{L}}]+'), "
    "lambda x: case when x[1] = 'ß' then 'Ss' else upper(x[1]) end || x[2:]), '')"
)
MINIMAL_SQL = f"regexp_replace(regexp_replace({{0}}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def minimal(c: str) -> str:
    return MINIMAL_SQL.format(c)


def moderate(c: str) -> str:
    kept = tx.KEPT_PUNCTUATION.replace("'", "''").replace('\\"', '"')
    return minimal(f"regexp_replace(regexp_replace({c}, '{SPACE}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}} {kept}]', '', 'g')")


def aggressive(c: str) -> str:
    plain = f"lower(translate(regexp_replace({c}, '{SPACE}+', ' ', 'g'), '{tx.ACCENTED}', '{tx.PLAIN}'))"
    return minimal(f"regexp_replace({plain}, '[^a-z0-9 ]', '', 'g')")


# ---------------------------------------------------------------- texts


@query("convert_case_lower", "X1", "select c_custkey, lower(c_name) as c_name, lower(c_mktsegment) as c_mktsegment from customer")
def _(t):
    return texts.convert_case(t.customer, ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("convert_case_upper", "X2", "select doc_id, upper(replace(text, 'ß', 'ss')) as text from documents")
def _(t):
    return texts.convert_case(t.documents.select("doc_id", "text"), ["text"], "upper")


@query("convert_case_title", "X3", f"select doc_id, {TITLE_SQL.format('text')} as text from documents")
def _(t):
    return texts.convert_case(t.documents.select("doc_id", "text"), ["text"], "title")


@query(
    "convert_case_sentence",
    "X4",
    "select p_partkey, upper(lower(p_name)[1]) || lower(p_name)[2:] as p_name, p_brand from part",
)
def _(t):
    df = texts.convert_case(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name"], "sentence")
    return texts.convert_case(df, ["p_brand"], "keep_original")


@query(
    "trim_text",
    "X5",
    f"select id, regexp_replace(nome, '^{SPACE}+|{SPACE}+$', '', 'g') as nome from dirty_customer",
)
def _(t):
    return texts.trim_text(t.dirty_customer.select("id", "nome"), ["nome"])


@query("normalize_whitespace", "X6", f"select doc_id, regexp_replace(text, '{SPACE}+', ' ', 'g') as text from documents")
def _(t):
    return texts.normalize_whitespace(t.documents.select("doc_id", "text"), ["text"])


@query("clean_text_minimal", "X7", f"select id, {minimal('nome')} as nome from dirty_customer")
def _(t):
    return texts.clean_text(t.dirty_customer.select("id", "nome"), ["nome"])


@query("clean_text_moderate", "X8", f"select page_id, {moderate('html')} as html from pages")
def _(t):
    return texts.clean_text(t.pages.select("page_id", "html"), ["html"], "moderate")


@query("clean_text_aggressive", "X9", f"select doc_id, {aggressive('text')} as text from documents")
def _(t):
    return texts.clean_text(t.documents.select("doc_id", "text"), ["text"], "aggressive")


@query(
    "clean_text_custom",
    "X10",
    "select doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '#[.,]#', '#', 'g') as text from documents",
)
def _(t):
    rules = [("[0-9]+", "#"), ("#[.,]#", "#")]
    return texts.clean_text(t.documents.select("doc_id", "text"), ["text"], "custom", rules)


@query("fix_encoding", "X11", "select id, nome, nome as repaired from dirty_customer")
def _(t):
    broken = F.decode(F.encode("nome", "UTF-8"), "ISO-8859-1")
    df = t.dirty_customer.select("id", "nome", broken.alias("repaired"))
    return texts.fix_encoding(df, ["repaired"])


@query(
    "remove_control_chars",
    "X12",
    """select doc_id, regexp_replace(replace(text, '.', chr(7)), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g') as text from documents""",
)
def _(t):
    df = t.documents.select("doc_id", F.replace("text", F.lit("."), F.lit("\u0007")).alias("text"))
    return texts.remove_control_chars(df, ["text"])


@query(
    "string_operations",
    "X13",
    """select c_custkey, trim(c_name) as strip, lower(c_name) as lower, upper(c_name) as upper,
         regexp_replace(c_name, '[0-9]+', 'N', 'g') as replace, contains(c_name, '#0000001') as contains,
         split_part(c_name, '#', 2) as split, regexp_extract(c_name, '#0*([0-9]+)', 1) as extract from customer""",
)
def _(t):
    df = t.customer.select("c_custkey", "c_name")
    df = texts.string_op(df, "c_name", "strip", "strip")
    df = texts.string_op(df, "c_name", "lower", "lower")
    df = texts.string_op(df, "c_name", "upper", "upper")
    df = texts.string_op(df, "c_name", "replace", "replace", pattern="[0-9]+", to="N")
    df = texts.string_op(df, "c_name", "contains", "contains", term="#0000001")
    df = texts.string_op(df, "c_name", "split", "split", sep="#", part=1)
    df = texts.string_op(df, "c_name", "extract", "extract", pattern="#0*([0-9]+)")
    return df.drop("c_name")


@query("remove_accents", "X14", f"select doc_id, translate(text, '{tx.ACCENTED}', '{tx.PLAIN}') as text from documents")
def _(t):
    return texts.remove_accents(t.documents.select("doc_id", "text"), ["text"])


# ---------------------------------------------------------------- duplicates


@query("remove_duplicates", "U1", "select distinct * from dup_events")
def _(t):
    return dedup.remove_duplicates(t.dup_events)


def _keep_sql(direction: str) -> str:
    return f"""select event_id, user_id, event_type, value, ts from dup_events
      qualify row_number() over (partition by user_id, event_type order by ts {direction}, event_id {direction}) = 1"""


@query("duplicates_keep_first", "U2", _keep_sql(""))
def _(t):
    return dedup.remove_duplicates(t.dup_events, ["user_id", "event_type"], "first", ["ts", "event_id"])


@query("duplicates_keep_last", "U3", _keep_sql("desc"))
def _(t):
    return dedup.remove_duplicates(t.dup_events, ["user_id", "event_type"], "last", ["ts", "event_id"])


@query(
    "duplicates_keep_none",
    "U4",
    """select event_id, user_id, event_type, value, ts from dup_events
       qualify count(*) over (partition by event_id) = 1""",
)
def _(t):
    return dedup.remove_duplicates(t.dup_events, ["event_id"], False)


@query(
    "duplicate_report",
    "U5",
    "select event_id, event_type, count(*) as count from dup_events group by all having count(*) > 1",
)
def _(t):
    return dedup.duplicate_report(t.dup_events, ["event_id", "event_type"])


@query(
    "duplicate_totals",
    "U5",
    """select count(*) as n_rows, (select count(*) from (select distinct * from dup_events)) as n_distinct,
       count(*) - (select count(*) from (select distinct * from dup_events)) as n_removed from dup_events""",
)
def _(t):
    return dedup.duplicate_totals(t.dup_events)


@query(
    "fuzzy_duplicates",
    "U6",
    """with s as (select s_suppkey as id, regexp_replace(lower(s_name), '[^a-z0-9 ]', '', 'g') as t from supplier)
       select a.id as id_a, b.id as id_b, levenshtein(a.t, b.t)::int as distance from s a join s b
       on a.id < b.id and abs(length(a.t) - length(b.t)) <= 1 and levenshtein(a.t, b.t) <= 1""",
)
def _(t):
    return dedup.fuzzy_duplicates(t.supplier, "s_suppkey", "s_name")


FUZZY_NAMES = """with r as (select id, """ + aggressive("nome") + """ as t from dirty_customer),
  h as (select t, min(id) as head from r group by t),
  links as (select a.head as id_a, b.head as id_b from h a join h b on a.head < b.head
      and abs(length(a.t) - length(b.t)) <= 1 and levenshtein(a.t, b.t) <= 1
    union all select h.head, r.id from r join h using (t) where r.id <> h.head)"""


@query(
    "fuzzy_duplicates_copies",
    "U6",
    FUZZY_NAMES + " select id_a, id_b from links",
)
def _(t):
    return dedup.fuzzy_duplicates(t.dirty_customer, "id", "nome").select("id_a", "id_b")


@query(
    "fuzzy_duplicates_blocked",
    "U6",
    """with s as (select c_custkey as id, c_mktsegment as seg, c_nationkey as nat, lower(c_name) as t from customer)
       select a.id as id_a, b.id as id_b, levenshtein(a.t, b.t)::int as distance from s a join s b
       on a.id < b.id and a.seg = b.seg and a.nat = b.nat and levenshtein(a.t, b.t) <= 2""",
)
def _(t):
    df = t.customer.withColumn("name", F.lower("c_name"))
    return dedup.fuzzy_duplicates(df, "c_custkey", "name", 2, ["c_mktsegment", "c_nationkey"], normalize=False)


@query(
    "near_documents",
    "U6 K17",
    """with recursive split as (
         select doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\f\\r\\x0B]+'), lambda x: x <> '') as w from documents),
       nodes as (select row_number() over (order by w) as node, w from (select distinct w from split where len(w) > 0)),
       runs as (select distinct node, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as run from nodes),
       sizes as (select node, count(*) as n from runs group by node),
       common as (select a.node as a, b.node as b, count(*) as c from runs a join runs b on a.run = b.run and a.node <> b.node group by a.node, b.node),
       near as (select a, b from common join sizes x on x.node = a join sizes y on y.node = b where c::double / (x.n + y.n - c) >= 0.8),
       walk(node, reach) as (select node, node from nodes union select w.node, e.b from walk w join near e on w.reach = e.a),
       classes as (select node, min(reach) as class from walk group by node),
       placed as (select s.doc_id, c.class from split s left join nodes n on s.w = n.w left join classes c on n.node = c.node)
       select doc_id as id, coalesce(min(doc_id) over (partition by class, class is null and doc_id is not null, case when class is null then doc_id end), doc_id) as class_id,
         count(*) over (partition by class, case when class is null then doc_id end) as class_size from placed""",
)
def _(t):
    return similar.near_documents(t.documents, "doc_id", "text")


@query(
    "consolidate",
    "U7",
    """with k as (select id, acctbal, case when segment in ('N/A', '--') then null else segment end as segment,
         (id - id % 7) as head, (acctbal is not null)::int + (segment is not null and segment not in ('N/A', '--'))::int as filled from dirty_customer),
       r as (select *, row_number() over (partition by head order by filled desc, id) as place from k)
       select max(case when place = 1 then id end) as id, arg_min(acctbal, place) filter (acctbal is not null) as acctbal,
         arg_min(segment, place) filter (segment is not null) as segment, count(*) as n_records from r group by head""",
)
def _(t):
    from dqengine.operators.nulls import normalize_nulls

    df = normalize_nulls(t.dirty_customer.select("id", "acctbal", "segment"), columns=["segment"])
    # neighbours within a week of ids are linked in a chain: 0-1-2-...-6, 7-8-...
    links = df.filter("id % 7 > 0").select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"))
    return dedup.consolidate(df, "id", links)


@query(
    "linked_groups",
    "U7",
    FUZZY_NAMES.replace("with r as", "with recursive r as")
    + """, both_ways as (select id_a as a, id_b as b from links union select id_b, id_a from links),
  walk(id, reach) as (select a, a from both_ways union select w.id, e.b from walk w join both_ways e on w.reach = e.a)
  select id, min(reach) as component from walk group by id""",
)
def _(t):
    return dedup.components(dedup.fuzzy_duplicates(t.dirty_customer, "id", "nome"))


# ---------------------------------------------------------------- grouping


@query(
    "aggregate",
    "A1",
    """with m as (select l_returnflag, l_linenumber, row_number() over (partition by l_returnflag order by count(*) desc, l_linenumber) as r
         from lineitem group by l_returnflag, l_linenumber)
       select l_returnflag, round(sum(l_quantity), 2) as l_quantity_sum, round(avg(l_quantity), 6) as l_quantity_mean,
         min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, count(l_quantity) as l_quantity_count,
         count(distinct l_suppkey) as l_suppkey_nunique, round(median(l_extendedprice), 6) as l_extendedprice_median,
         (select l_linenumber from m where m.l_returnflag = lineitem.l_returnflag and r = 1) as l_linenumber_mode,
         round(stddev_samp(l_tax), 6) as l_tax_std
       from lineitem group by l_returnflag""",
)
def _(t):
    out = ag.aggregate(
        t.lineitem,
        ["l_returnflag"],
        {
            "l_quantity": ["sum", "mean", "min", "max", "count"],
            "l_suppkey": "nunique",
            "l_extendedprice": "median",
            "l_linenumber": "mode",
            "l_tax": "std",
        },
    )
    rounded = {"l_quantity_sum": 2, "l_quantity_mean": 6, "l_extendedprice_median": 6, "l_tax_std": 6}
    return out.withColumns({c: F.round(c, n) for c, n in rounded.items()})


@query("value_counts", "A2", "select event_type as value, count(*) as count from events group by event_type")
def _(t):
    return ag.value_counts(t.events, "event_type")


@query(
    "transform_agg",
    "A3",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity / avg(l_quantity) over (partition by l_suppkey), 6) as share
       from lineitem""",
)
def _(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    out = ag.transform_agg(t.lineitem.select(*keys, "l_quantity"), ["l_suppkey"], "l_quantity", "mean")
    return out.select(*keys, F.round(F.col("l_quantity") / F.col("l_quantity_mean"), 6).alias("share"))


@query(
    "chart_line",
    "A4",
    "select date_trunc('day', ts)::timestamp as x, round(sum(value), 6) as y from events group by 1",
)
def _(t):
    return ag.chart_data(t.events, "ts", "value", "line").withColumn("y", F.round("y", 6))


@query("chart_bar", "A4", "select event_type as x, count(*) as y from events group by 1")
def _(t):
    return ag.chart_data(t.events, "event_type")


@query(
    "chart_histogram",
    "A4",
    """with e as (select min(value) as lo, max(value) as hi from events)
       select least(floor((value - lo) / (hi - lo) * 10), 9)::int as x, count(*) as y from events, e group by 1""",
)
def _(t):
    return ag.chart_data(t.events, "value", None, "histogram")


# ---------------------------------------------------------------- text tables


@query(
    "extract_lines",
    "T1",
    f"""with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
       c as (select doc_id, n, regexp_replace(regexp_replace(regexp_replace(line, '^["'']|["'']$', '', 'g'), '^[-*•]{SPACE}*', ''), '^[0-9]+\\.{SPACE}*', '') as line
         from l where line <> '' and not starts_with(line, '#') and not starts_with(line, '//')),
       k as (select *, row_number() over (partition by doc_id order by n) as r from c where length(line) > 5 and length(line) < 100)
       select doc_id, (r - 1)::int as position, line from k where r <= 10""",
)
def _(t):
    return tj.extract_lines(t.documents, "doc_id", "text")


@query(
    "keyword_sentences",
    "T2",
    f"""with l as (select doc_id, unnest(list_transform(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'))) as s,
         generate_subscripts(string_split_regex(text, '[.!?]'), 1) as n from documents),
       k as (select *, row_number() over (partition by doc_id order by n) as r from l
         where length(s) > 5 and length(s) < 100 and regexp_matches(lower(s), 'the|que|und'))
       select doc_id, (r - 1)::int as position, s as sentence from k where r <= 6""",
)
def _(t):
    return tj.keyword_sentences(t.documents, "doc_id", "text", ["the", "que", "und"])


@query(
    "extract_json",
    "T3",
    """select event_id, case when event_id % 4 = 3 then null else (props->>'k')::int end as k,
         case event_id % 4 when 0 then 'whole' when 1 then 'fenced' when 2 then 'braces' end as json_method from events""",
)
def _(t):
    fence = "```"
    text = F.expr(
        f"case event_id % 4 when 0 then concat(' ', props, ' ') "
        f"when 1 then concat('here {{it}} is: {fence}json ', props, ' {fence} and more }}') "
        f"when 2 then concat('so ', props, ' it is') else 'no {{ object' end"
    )
    df = t.events.select("event_id", text.alias("text"))
    return tj.extract_json(df, "text", "k int").select("event_id", F.col("parsed.k").alias("k"), "json_method")


@query(
    "extract_json_prose",
    "T3",
    "select event_id, (props->>'k')::int as k, 'balanced' as json_method from events",
)
def _(t):
    # braces that are no object stand before and after the one that is
    text = F.expr("concat('note {', event_id, '} says \"it: ', props, ' and {more} \" end')")
    df = t.events.select("event_id", text.alias("text"))
    return tj.extract_json(df, "text", "k int").select("event_id", F.col("parsed.k").alias("k"), "json_method")


@query(
    "truncate_paragraphs",
    "T4",
    """with p as (select doc_id, text, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
       s as (select *, sum(length(part)) over (partition by doc_id order by n) as total from p),
       k as (select doc_id, coalesce(string_agg(part, chr(10) order by n) filter (total <= 1500), '') as short from s group by doc_id)
       select doc_id, case when length(text) <= 1500 then text when length(short) < length(text) then short || ' [cut]' else short end as text
       from documents join k using (doc_id)""",
)
def _(t):
    return tj.truncate_paragraphs(t.documents.select("doc_id", "text"), "text", 1500, "\n", " [cut]")


PAGE_PATTERNS = {
    "links": r"<a\s+href=",
    "items": r"<li>",
    "scripts": r"<script\b",
    "entities": r"&\w+;",
    **tj.FUNCTIONAL_PATTERNS,
    **tj.FRAME_PATTERNS,
}


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


PRESENT = ", ".join(f"case when {_count_sql(p)} > 0 then '{n}' end" for n, p in PAGE_PATTERNS.items())


@query(
    "pattern_counts",
    "T5",
    "select page_id, "
    + ", ".join(f"{_count_sql(p)}::int as {n}" for n, p in PAGE_PATTERNS.items())
    + f", array_to_string(list_filter([{PRESENT}], lambda x: x is not null), ',') as present from pages",
)
def _(t):
    return tj.pattern_counts(t.pages.select("page_id", "html"), "html", PAGE_PATTERNS).drop("html")


@query(
    "rubric_score",
    "T6",
    """with c as (select doc_id, len(string_split(text, chr(10))) as n_lines, len(regexp_extract_all(text, '[.!?]')) as n_ends,
         len(regexp_extract_all(text, '[0-9]')) as n_digits, length(text) as n_chars from documents),
       s as (select doc_id, least(100.0, greatest(0.0, case when n_lines >= 3 then 15 else 0 end + case when n_chars > 200 then 40 else 0 end
         + case when n_ends > 5 then 35 else 0 end - case when n_digits > 3 then 15 else 0 end))::double as score from c)
       select *, case when score >= 85 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'needs_improvement' else 'poor' end as band from s""",
)
def _(t):
    counts = tj.pattern_counts(
        t.documents.select("doc_id", "text"), "text", {"n_breaks": "\n", "n_ends": "[.!?]", "n_digits": "[0-9]"}
    )
    rules = [("n_breaks >= 2", 15), ("length(text) > 200", 40), ("n_ends > 5", 35), ("n_digits > 3", -15)]
    return tj.rubric_score(counts, rules).select("doc_id", "score", "band")


@query(
    "weighted_complexity",
    "T7",
    """select page_id, (len(regexp_extract_all(html, '<script\\b')) * 5 + len(regexp_extract_all(html, '<li>')) * 3
         + len(regexp_extract_all(html, '&\\w+;')) * 2)::double as complexity from pages""",
)
def _(t):
    patterns = {n: PAGE_PATTERNS[n] for n in ("scripts", "items", "entities")}
    counts = tj.pattern_counts(t.pages.select("page_id", "html"), "html", patterns)
    return tj.weighted_complexity(counts, {"scripts": 5, "items": 3, "entities": 2}).select("page_id", "complexity")
