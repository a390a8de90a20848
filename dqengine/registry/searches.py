"""Retrieval: benchmark texts as queries, documents and pages as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.operators import profile as pf
from dqengine.operators import retrieval as rt
from dqengine.registry.base import query


def _chunks(t) -> DataFrame:
    return rt.corpus(t.documents, "doc_id", "text", F.col("source"), F.concat_ws("-", "source", "lang"), F.col("lang"))


def _questions(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _vectors(t) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _centroids(t) -> DataFrame:
    """The mean vector of each label, as queries."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("cells"))
    return ordered.select(F.col("label").alias("query_id"), F.transform("cells", lambda c: c["x"]).alias("vector"))


def _chunks_with_vectors(t) -> DataFrame:
    return _chunks(t).join(_vectors(t), "chunk_id", "left")


def _questions_with_vectors(t) -> DataFrame:
    return _questions(t).join(_vectors(t).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")


# ---------------------------------------------------------------- SQL pieces

UNIT = """list_transform({0}::double[], lambda x: x / sqrt(list_dot_product({0}::double[], {0}::double[])))"""
WORDS = "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')"
CENTROIDS = f"""with cells as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
  means as (select label, i, avg(x) as x from cells group by all),
  q as (select label as query_id, list(x order by i) as v from means group by label),
  qn as (select query_id, {UNIT.format('v')} as v from q),
  cn as (select vec_id as chunk_id, {UNIT.format('embedding')} as v from embeddings),
  pairs as (select query_id, chunk_id, round(list_dot_product(qn.v, cn.v), 9) as score from qn, cn),
  ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from pairs)"""
KEYWORD = f"""qw as (select item_id as query_id, list_distinct({WORDS.format('text')}) as w from benchmark),
  qx as (select query_id, len(w) as n, unnest(w) as word from qw),
  cx as (select doc_id as chunk_id, unnest(list_distinct({WORDS.format('text')})) as word from documents),
  kw as (select query_id, chunk_id, count(*) / any_value(n) as score from qx join cx using (word) group by query_id, chunk_id),
  kr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from kw)"""


def bm25(table: str, key: str, text: str) -> str:
    return f"""qx as (select item_id as query_id, unnest(list_distinct({WORDS.format('text')})) as word from benchmark),
  docs as (select {key} as chunk_id, {WORDS.format(text)} as w from {table}),
  tot as (select count(*) as n, avg(len(w)) as mean from docs),
  cx as (select chunk_id, len(w) as length, unnest(w) as word from docs),
  tf as (select chunk_id, word, count(*) as tf, any_value(length) as length from cx group by chunk_id, word),
  df as (select word, count(*) as df from tf group by word),
  bm as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score
    from qx join tf using (word) join df using (word), tot group by query_id, chunk_id),
  tfi as (select query_id, chunk_id, sum(tf * ln(n / df)) as score
    from qx join tf using (word) join df using (word), tot group by query_id, chunk_id)"""


# Vector scores of the benchmark items that have a vector against the chunks that have one.
DENSE_BY_ID = f"""vn as (select vec_id, {UNIT.format('embedding')} as v from embeddings),
  dq as (select item_id as query_id, v from benchmark join vn on item_id = vec_id),
  dp as (select query_id, vec_id as chunk_id, round(list_dot_product(dq.v, vn.v), 9) as score from dq, vn where vec_id in (select doc_id from documents)),
  dr as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dp)"""

# ---------------------------------------------------------------- corpora


@query(
    "corpus",
    "R1",
    "select doc_id as chunk_id, text as content, source, source || '-' || lang as title, lang as category from documents",
)
def _(t):
    return _chunks(t)


@query(
    "chunk_text",
    "R2",
    """with s as (select doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) as start from documents)
       select doc_id, (start // 800)::int as chunk_no, text[start + 1 : start + 1000] as content from s""",
)
def _(t):
    return rt.chunk_text(t.documents, "doc_id", "text")


@query(
    "l2_normalize",
    "R3",
    f"""with v as (select vec_id, {UNIT.format('embedding')} as v from embeddings)
        select vec_id, generate_subscripts(v, 1)::int as i, round(unnest(v), 6) as x from v""",
)
def _(t):
    df = rt.l2_normalize(t.embeddings.select("vec_id", "embedding"), "embedding")
    return df.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x")
    )


# ---------------------------------------------------------------- searches

SHOWN = "query_id, chunk_id, round(score, 6) as score, rank"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("dense_search", "R4", f"{CENTROIDS} select {SHOWN} from ranked where rank <= 10 and score >= 0.3")
def _(t):
    return _shown(rt.dense_search(_centroids(t), _vectors(t)))


@query(
    "dense_search_floor",
    "R10",
    f"""with {DENSE_BY_ID.replace(' where vec_id in (select doc_id from documents)', '')}
        select {SHOWN} from dr where rank <= 50 and score >= 0.7""",
)
def _(t):
    return _shown(rt.dense_search(_questions_with_vectors(t), _vectors(t), 50, rt.MIN_DENSE))


@query("keyword_search", "R5", f"with {KEYWORD} select {SHOWN} from kr where rank <= 10")
def _(t):
    return _shown(rt.keyword_search(_questions(t), _chunks(t)))


@query(
    "hybrid_search",
    "R6",
    f"""with {KEYWORD}, {DENSE_BY_ID},
  h as (select coalesce(d.query_id, k.query_id) as query_id, coalesce(d.chunk_id, k.chunk_id) as chunk_id,
      coalesce(d.score, 0) * 0.7 + coalesce(k.score, 0) * 0.3 as score
    from (select * from dr where rank <= 20 and score >= 0.3) d full outer join (select * from kr where rank <= 10) k
      on d.query_id = k.query_id and d.chunk_id = k.chunk_id),
  hr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from h)
  select {SHOWN} from hr where rank <= 10""",
)
def _(t):
    return _shown(rt.hybrid_search(_questions_with_vectors(t), _chunks_with_vectors(t)))


@query(
    "hybrid_search_without_vectors",
    "R6",
    f"""with {KEYWORD},
  h as (select d.query_id, d.chunk_id, d.score * 0.7 + coalesce(k.score, 0) * 0.3 as score
    from (select * from kr where rank <= 20) d left join (select * from kr where rank <= 10) k
      on d.query_id = k.query_id and d.chunk_id = k.chunk_id),
  hr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from h)
  select {SHOWN} from hr where rank <= 10""",
)
def _(t):
    return _shown(rt.hybrid_search(_questions(t), _chunks(t)))


PACKED = """, parts as (select query_id, rank, score, '[' || source || '-' || lang || ']' || chr(10) || text || chr(10) as part
    from {ranked} join documents on doc_id = chunk_id),
  placed as (select *, sum(case when score >= 0.05 then length(part) else 0 end) over (partition by query_id order by rank) as total from parts),
  packed as (select query_id, coalesce(string_agg(part, chr(10) || '---' || chr(10) order by rank) filter (score >= 0.05 and total <= {limit}),
      arg_min(part, rank)) as context from placed group by query_id)"""


@query(
    "pack_context",
    "R7",
    f"with {KEYWORD}, top as (select * from kr where rank <= 10)"
    + PACKED.format(ranked="top", limit=4000)
    + """ select item_id as query_id, coalesce(context, 'No relevant documentation found.') as context
         from benchmark left join packed on item_id = query_id""",
)
def _(t):
    chunks = _chunks(t)
    return rt.pack_context(rt.keyword_search(_questions(t), chunks), chunks, _questions(t))


@query(
    "search_many",
    "R8",
    f"""with {KEYWORD},
  h as (select d.query_id, d.chunk_id, d.score * 0.7 + coalesce(k.score, 0) * 0.3 as score
    from (select * from kr where rank <= 16) d left join (select * from kr where rank <= 8) k
      on d.query_id = k.query_id and d.chunk_id = k.chunk_id),
  hr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from h),
  top as (select * from hr where rank <= 8)"""
    + PACKED.format(ranked="top", limit=800)
    + """ select query_id, 'Query: ' || text || chr(10) || chr(10) || 'Relevant Documentation:' || chr(10) || context as document
         from packed join benchmark on item_id = query_id""",
)
def _(t):
    return rt.search_many(_questions(t), _chunks(t))


RANKED_BM = "select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {0}"


@query(
    "sparse_search_bm25",
    "R9",
    f"with {bm25('documents', 'doc_id', 'text')}, br as ({RANKED_BM.format('bm')}) select {SHOWN} from br where rank <= 10 and score >= 5",
)
def _(t):
    return _shown(rt.sparse_search(_questions(t), _chunks(t)))


@query(
    "sparse_search_tfidf",
    "R9",
    f"with {bm25('documents', 'doc_id', 'text')}, br as ({RANKED_BM.format('tfi')}) select {SHOWN} from br where rank <= 10 and score >= 5",
)
def _(t):
    return _shown(rt.sparse_search(_questions(t), _chunks(t), "tfidf"))


# ---------------------------------------------------------------- pages: fuse, dedup, rerank


def _page_chunks(t) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    vectors = t.embeddings.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))
    return t.pages.join(vectors, "page_id", "left").select(
        F.col("page_id").alias("chunk_id"), F.col("html").alias("content"), "url", title.alias("title"), "vector"
    )


def _page_results(t) -> tuple[DataFrame, DataFrame]:
    pages = _page_chunks(t)
    named = pages.select("chunk_id", "url", "title")
    sparse = rt.sparse_search(_questions(t), pages, min_score=0.5).join(named, "chunk_id")
    dense = rt.dense_search(_questions_with_vectors(t).filter("vector is not null"), pages, 10, 0.1).join(named, "chunk_id")
    none = F.lit(None).cast("double")
    return (
        sparse.select("query_id", "url", "title", F.col("score").alias("sparse_score"), none.alias("dense_score")),
        dense.select("query_id", "url", "title", F.lit(0.0).alias("sparse_score"), F.col("score").alias("dense_score")),
    )


FUSED = f"""with {bm25('pages', 'page_id', 'html')}, br as ({RANKED_BM.format('bm')}),
  {DENSE_BY_ID.replace('select doc_id from documents', 'select page_id from pages')},
  named as (select page_id as chunk_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) as title from pages),
  s as (select query_id, url, title, score as sparse_score, null::double as dense_score from br join named using (chunk_id) where rank <= 10 and score >= 0.5),
  d as (select query_id, url, title, 0.0::double as sparse_score, score as dense_score from dr join named using (chunk_id) where rank <= 10 and score >= 0.1),
  fused as (select *, 'documentation' as source_type from s
    union all select *, 'community' from d where not exists (from s where s.query_id = d.query_id and s.url = d.url)),
  f as (select *, coalesce(sparse_score, 0) * 0.6 + coalesce(dense_score, 0) * 0.4 as hybrid_score from fused)"""


@query("fuse", "R11", FUSED + " select query_id, url, source_type, round(hybrid_score, 6) as hybrid_score from f")
def _(t):
    fused = rt.fuse(*_page_results(t))
    return fused.select("query_id", "url", "source_type", F.round("hybrid_score", 6).alias("hybrid_score"))


FIRST = """, o as (select *, row_number() over (partition by query_id order by source_type desc, round(hybrid_score, 9) desc, url) as rank from f),
  first as (select * from o qualify row_number() over (partition by query_id, url order by rank) = 1)"""


def _first_results(t) -> DataFrame:
    from pyspark.sql.window import Window

    fused = rt.fuse(*_page_results(t))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("source_type"), F.round("hybrid_score", 9).desc(), F.col("url")
    )
    return rt.dedup_results(fused.withColumn("rank", F.row_number().over(order)))


@query("dedup_results", "R12", FUSED + FIRST + " select url, query_id, rank from first")
def _(t):
    return _first_results(t).select("url", "query_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rerank",
    "R13",
    FUSED + FIRST + """, b as (select query_id, url, hybrid_score * case when contains(url, 'blog.') then 1.3 when contains(url, 'example.org') then 1.2 else 1.0 end
      * case when regexp_matches(lower(title), 'the|und|que') then 1.1 else 1.0 end as rerank_score from first)
  select query_id, url, round(rerank_score, 6) as rerank_score from b
  qualify row_number() over (partition by query_id order by round(b.rerank_score, 9) desc, url) <= 5""",
)
def _(t):
    out = rt.rerank(_first_results(t), (("blog.", 1.3), ("example.org", 1.2)), ("the", "und", "que"), max_results=5)
    return out.select("query_id", "url", F.round("rerank_score", 6).alias("rerank_score"))


# ---------------------------------------------------------------- queries as data

OPERATIONS = tuple(rt.DOCUMENTATION_TERMS)
ASKED = f"""concat(p_name, ' ', case p_partkey % 8 {' '.join(f"when {i} then '{o}'" for i, o in enumerate(OPERATIONS))} else 'pandas tour' end)"""


def _asked(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("query_id"), F.expr(ASKED).alias("text"))


def _terms_sql() -> str:
    parts = []
    for key, terms in rt.DOCUMENTATION_TERMS.items():
        test = " or ".join(f"contains(lower(text), '{w}')" for w in key.split())
        values = ", ".join(f"'{v}'" for v in terms)
        parts.append(f"case when {test} then [{values}] else [] end")
    return " || ".join(parts)


EXPANDED = f"""with a as (select p_partkey as query_id, {ASKED} as text from part),
  e as (select query_id, [text] || ({_terms_sql()})[1:3] as l from a),
  x as (select query_id, unnest(l) as text, (generate_subscripts(l, 1) - 1)::int as position from e)"""


@query("expand_queries", "R14", EXPANDED + " select query_id, position, text from x")
def _(t):
    return rt.expand_queries(_asked(t))


@query(
    "expand_templates",
    "R15",
    " union all ".join(
        f"select item_id as query_id, '{s}' as strategy, {i} as position, {e} as text from benchmark"
        for s, forms in rt.TEMPLATES.items()
        for i, e in enumerate(["text", *[" || ".join(x for x in (f"'{b}'" if b else "", "text", f"'{a}'" if a else "") if x) for b, a in (f.split("{}") for f in forms)]])
    ),
)
def _(t):
    out = None
    for strategy in rt.TEMPLATES:
        one = rt.expand_templates(_questions(t), strategy).select("query_id", F.lit(strategy).alias("strategy"), "position", "text")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "merge_queries",
    "R16",
    EXPANDED + """, l as (select p_type as list_id, text, min(query_id * 10 + position) as position from x join part on query_id = p_partkey group by p_type, text)
  select list_id, text, row_number() over (partition by list_id order by position, text) as rank from l
  qualify row_number() over (partition by list_id order by position, text) <= 15""",
)
def _(t):
    expanded = rt.expand_queries(_asked(t)).join(t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("list_id")), "query_id")
    lists = expanded.select("list_id", (F.col("query_id") * 10 + F.col("position")).alias("position"), "text")
    return rt.merge_queries(lists).select("list_id", "text", F.col("rank").cast("bigint").alias("rank"))


def _any_sql(terms) -> str:
    return " or ".join(f"contains(lower(text), '{x}')" for x in terms)


@query(
    "adaptive_threshold",
    "R17",
    f"""with g as (select source, avg(({_any_sql(rt.TECHNICAL_TERMS)})::int) as s,
         bool_or({_any_sql(pf.KEYWORD_GROUPS['has_mixed_types'])})::int + bool_or({_any_sql(pf.KEYWORD_GROUPS['has_encoding_issues'])})::int
           + bool_or({_any_sql(pf.KEYWORD_GROUPS['is_large_dataset'])})::int as c from documents group by source)
       select source, round(s, 6) as specificity, c as complexity,
         greatest(3.0, 6.0 - case when s > 0.8 then 2.5 when s > 0.5 then 1.5 when s > 0.2 then 1.0 else 0 end
           - case when c >= 2 then 1.5 when c >= 1 then 1.0 else 0 end)::double as threshold from g""",
)
def _(t):
    names = ("has_mixed_types", "has_encoding_issues", "is_large_dataset")
    flagged = pf.keyword_flags(t.documents.select("source", "text"), "text", {n: pf.KEYWORD_GROUPS[n] for n in names})
    out = rt.adaptive_threshold(flagged, ["source"], names)
    return out.withColumn("specificity", F.round("specificity", 6))


@query(
    "graded_filter",
    "R18",
    """select doc_id, grade from (select doc_id, case when doc_id % 3 = 0 then 0 else (n_chars % 12)::int end as grade from documents) where grade >= 6.0""",
)
def _(t):
    grade = F.when(F.col("doc_id") % 3 == 0, "no grade").otherwise(
        F.concat(F.lit(" Score="), (F.col("n_chars") % 12).cast("string"), F.lit(", Reason=x"))
    )
    graded = t.documents.select("doc_id", F.concat("text", grade).alias("text"))
    return rt.graded_filter(graded, "text", rt.BASE_THRESHOLD).select("doc_id", "grade")
