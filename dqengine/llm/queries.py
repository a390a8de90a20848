"""The registered queries of the subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_text, langid, lexical, line_dedup, mixing, quality_crf, quality_rules, simhash, suffix_tree, token_files, toxicity
from .tables import fold


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    model = langid.train(docs.filter(~F.col("held_out")))
    guess = docs.select("doc_id", "held_out", langid.predict(model, F.col("text")).alias("guess"))
    return guess.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op2_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = quality_crf.train(docs.filter(~F.col("held_out")), _table(spark, folder, "labels"))
    scored = docs.select("doc_id", "held_out", quality_crf.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *names, "base_failed", "kept")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op9_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_texts(_table(spark, folder, "documents"), fold("doc_id", 7) == 2)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = toxicity.train(docs.filter(~F.col("held_out")), _table(spark, folder, "labels"))
    scored = docs.select("doc_id", "held_out", toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build_index(_table(spark, folder, "documents")), _table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    texts = html_text.extract(pages, html_text.train(pages))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_toxicity": op10_toxicity,
    "op11_lexical": op11_lexical,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_html_text": op13_html_text,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RISK = 0.02 / len(quality_rules.RULES)
_STEPS = " union all ".join(
    f"select doc_id, stratum, '{r.name}' as rule, {i} as step, {float(c)!r}::double as cutoff, ({r.sql.replace('0D', '0.0::double').replace('1D', '1.0::double')}) > {float(c)!r}::double as over from judged"
    for r in quality_rules.RULES
    for i, c in enumerate(r.cutoffs)
)

ORACLES: dict[str, str] = {
    "op4_quality_rules": rf"""
with split as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'g': w[i:i + 7]}}), recursive := true) from split where len(w) >= 8),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from twice) group by doc_id),
measured as (
  select s.doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(c.n, 0) as n_repeat_words,
    len(text) - len(regexp_replace(text, '\p{{Lu}}+', '', 'g')) as n_upper, len(list_distinct(w)) as n_distinct
  from split s left join covered c on s.doc_id = c.doc_id),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    case when n_words < 100 then 'short' when n_words < 1000 then 'middle' else 'long' end as stratum from measured),
steps as ({_STEPS}),
good as (
  select doc_id from judged where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)),
counted as (
  select stratum, rule, step, any_value(cutoff) as cutoff, count(*) as n, count(*) filter (where over) as k
  from steps where doc_id in (select doc_id from good) group by stratum, rule, step),
tested as (
  select *, k < n * {_RISK!r}::double and list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK!r}::double) + (n - j) * ln(1 - {_RISK!r}::double))))
    <= 0.05 / (select count(distinct stratum) * {len(quality_rules.RULES)} from counted) as safe from counted),
-- along the grid the first failure ends a sequence of tests
chosen as (
  select stratum, rule, max(step) as step from (
    select *, bool_and(safe) over (partition by stratum, rule order by step) as open from tested) where open group by stratum, rule),
rejected as (select distinct s.doc_id from steps s join chosen c on s.stratum = c.stratum and s.rule = c.rule and s.step = c.step where s.over)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from rejected) as kept from judged""",
    "op6_decontaminate": rf"""
with docs as (select doc_id, {_TERMS} as w from documents),
items as (select cast(item_id as varchar) as item, {_TERMS} as w from benchmark),
asked as (
  select distinct item, g from (select item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) as g from items where len(w) > 0)),
sizes as (select distinct len(g) as n from asked),
places as (
  select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': w[i:i + n - 1]}}), recursive := true) from docs, sizes where len(w) >= n),
hits as (select p.doc_id, p.i, p.n, a.item from places p join asked a on p.g = a.g),
words_hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as listed from hits group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words_hit h on d.doc_id = h.doc_id left join found f on d.doc_id = f.doc_id""",
    "op7_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as (
  select key, min(doc_id) as keeper from keyed where length(key) >= 10
  group by key having count(distinct doc_id) >= 2),
marked as (
  select k.*, coalesce(k.doc_id <> s.keeper, false) as gone from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op8_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [3.0, 1.0, 2.0][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1]::double as w
  from sized group by source),
ratios as (
  select *, 2.0::double * source_size / w as ratio, sum(source_size) over () as total from sources),
-- sources are capped in the order of cap over weight; the level holds once the first open source stays below its cap
levels as (
  select *,
    (1.5::double * total - coalesce(sum(2.0::double * source_size) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by ratio, source rows between current row and unbounded following) as level
  from ratios),
level as (select level from levels where level <= ratio order by ratio, source limit 1),
targets as (
  select source, source_size, least(w * level.level, 2.0::double * source_size) as target from sources, level),
rated as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(cast(s.doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (floor(rate) + (case when u < rate - floor(rate) then 1 else 0 end)))::bigint as taken
from rated""",
    "op11_lexical": rf"""
with docs as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
totals as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from docs where len(w) > 0),
counted as (select r, t, count(*) as tf from (select r, unnest(w) as t from docs) group by r, t),
weighted as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counted, totals group by t, n_docs),
normed as (select r, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) as m from docs, totals where len(w) > 0),
asked as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
scored as (
  select a.item_id, d.r, d.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * d.m)))::bigint as score
  from asked a join weighted w on a.t = w.t join counted c on a.t = c.t join normed d on c.r = d.r group by all),
placed as (select *, row_number() over (partition by item_id order by score desc, doc_id, r) as place from scored where score > 0)
select item_id, place::int as rank, doc_id, score from placed where place <= 10""",
    "op12_hard_negatives": """
with rows_of as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from rows_of a join rows_of b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (
  select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
negatives as (
  select p.anchor_id, p.other as positive_id, n.other as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.other order by n.score desc, n.other)::int as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id
  where not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select * from negatives where rank <= 3""",
}
