"""The quality audit: nineteen measured checks in eight categories, a score and a gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import dates as dt
from dqengine.functions import names as nn
from dqengine.functions import numbers as nm
from dqengine.functions import text as tx
from dqengine.operators import columns as cols
from dqengine.operators import dedup, nulls, numeric
from dqengine.operators import profile as pf
from dqengine.operators import stats as st
from dqengine.operators.textjobs import band

# Category and priority of every check, in report order.
CHECKS = {
    "shape": ("structure", "high"),
    "needless_columns": ("structure", "medium"),
    "naming_pattern": ("naming", "high"),
    "special_name_chars": ("naming", "medium"),
    "right_types": ("data_types", "high"),
    "date_formats": ("data_types", "high"),
    "missing_numeric": ("missing_values", "high"),
    "missing_text": ("missing_values", "high"),
    "implicit_nulls": ("missing_values", "medium"),
    "case": ("text_formatting", "medium"),
    "outer_spaces": ("text_formatting", "medium"),
    "encoding": ("text_formatting", "low"),
    "outliers": ("numeric_values", "medium"),
    "scale": ("numeric_values", "high"),
    "separators": ("numeric_values", "medium"),
    "exact_duplicates": ("duplicates", "high"),
    "partial_duplicates": ("duplicates", "medium"),
    "row_rules": ("business_rules", "high"),
    "relations": ("business_rules", "medium"),
}
# Weight of each priority; an unknown item counts low, an unknown minimum medium.
PRIORITY = {"high": 3, "medium": 2, "low": 1}
UNKNOWN_ITEM, UNKNOWN_MINIMUM = 1, 2
# What passes the gate, and the target of an improvement.
MIN_SCORE, MIN_SUCCESS, TARGET_SCORE = 70.0, 0.7, 80.0

SCHEMA = (
    "check_id string, category string, priority string, column string, "
    "n_rows bigint, n_violations bigint, rate double, detail string"
)


@dataclass(frozen=True)
class Rule:
    """A condition every row keeps; a NULL outcome is no violation."""

    name: str
    condition: str


@dataclass(frozen=True)
class Determines:
    """Every value of ``child`` belongs to one value of ``parent``."""

    child: str
    parent: str


@dataclass(frozen=True)
class Exists:
    """Every present value of ``column`` occurs in ``other[key]``."""

    column: str
    other: DataFrame
    key: str


@dataclass(frozen=True)
class Similar:
    """Where to look for similar records."""

    id_col: str
    column: str
    max_distance: int = 1
    block: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scale:
    """A number whose scale should be the same in every group."""

    column: str
    by: tuple[str, ...]


def _row(check: str, column: Column, rows: Column, bad: Column, detail: Column | None = None) -> Column:
    category, priority = CHECKS[check]
    return F.struct(
        F.lit(check).alias("check_id"),
        F.lit(category).alias("category"),
        F.lit(priority).alias("priority"),
        column.cast("string").alias("column"),
        rows.cast("bigint").alias("n_rows"),
        bad.cast("bigint").alias("n_violations"),
        F.coalesce(F.try_divide(bad.cast("double"), rows.cast("double")), F.lit(0.0)).alias("rate"),
        (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
    )


def selected(categories: Sequence[str] = (), min_priority: str = "medium") -> list[str]:
    """Checks of the categories (none given: all) with at least the priority."""
    least = PRIORITY.get(min_priority, UNKNOWN_MINIMUM)
    return [
        check
        for check, (category, priority) in CHECKS.items()
        if PRIORITY.get(priority, UNKNOWN_ITEM) >= least and (not categories or category in categories)
    ]


def audit(
    df: DataFrame,
    rules: Sequence[Rule] = (),
    relations: Sequence[Determines | Exists | Rule] = (),
    similar: Similar | None = None,
    scale: Scale | None = None,
    categories: Sequence[str] = (),
    min_priority: str = "medium",
    checks: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(check_id, category, priority, column, n_rows, n_violations, rate, detail)``.

    ``checks`` names the only checks to run, of those that categories and priority leave. Every check on single columns and rows is part of one aggregation over the
    table; only checks that must group (case, duplicates, relations, scale) add a job.
    """
    want = set(selected(categories, min_priority))
    if unknown := set(checks) - set(CHECKS):
        raise ValueError(f"unknown checks {sorted(unknown)}")
    want = want & set(checks) if checks else want
    parts = [_single_pass(df, want, rules, relations)]
    if "naming_pattern" in want or "special_name_chars" in want:
        parts.append(_naming(cols.names_table(df), want))
    texts = [c for c in df.columns if st.is_text(df, c)]
    if "case" in want and texts:
        parts.append(_case(df, texts))
    if "scale" in want and scale:
        groups = numeric.scale_check(df, scale.column, scale.by)
        found = groups.agg(F.count("*").alias("n"), F.count_if("suspicious").alias("bad"))
        parts.append(_rows(found, [_row("scale", F.lit(scale.column), F.col("n"), F.col("bad"), F.lit("groups"))]))
    if "exact_duplicates" in want:
        t = dedup.duplicate_totals(df)
        parts.append(_rows(t, [_row("exact_duplicates", F.lit(None), F.col("n_rows"), F.col("n_removed"))]))
    if "partial_duplicates" in want and similar:
        links = dedup.fuzzy_duplicates(df, similar.id_col, similar.column, similar.max_distance, similar.block)
        n = df.agg(F.count("*").alias("n")).scalar()
        hit = links.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        found = hit.agg(F.count("*").alias("bad")).withColumn("n", n)
        parts.append(_rows(found, [_row("partial_duplicates", F.lit(similar.column), F.col("n"), F.col("bad"))]))
    if "relations" in want:
        parts += [_relation(df, r) for r in relations if not isinstance(r, Rule)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rows(one: DataFrame, cells: Sequence[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*cells)))


def _single_pass(df: DataFrame, want: set[str], rules: Sequence[Rule], relations: Sequence) -> DataFrame:
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    cells: list[Column] = []
    rows = F.col("rows")

    def measure(expr: Column) -> Column:
        name = f"a{len(aggs)}"
        aggs.append(expr.alias(name))
        return F.col(name)

    if "shape" in want:
        detail = F.concat(rows.cast("string"), F.lit(f" rows x {len(df.columns)} columns"))
        cells.append(_row("shape", F.lit(None), rows, F.lit(0), detail))
    numbers = [c for c in df.columns if st.is_number(df, c)]
    marked = numeric.with_fences(df, numbers) if "outliers" in want and numbers else df
    for name in df.columns:
        v, label = st.present(df, name), F.lit(name)
        text, number = st.is_text(df, name), name in numbers
        if "needless_columns" in want:
            shown = pf.shown(df, name)
            present_n, lo, hi = measure(F.count(shown)), measure(F.min(shown)), measure(F.max(shown))
            flat = F.coalesce(lo == hi, F.lit(True))
            detail = F.when(present_n == 0, "empty").when(flat, "constant").otherwise("")
            cells.append(_row("needless_columns", label, F.lit(1), flat.cast("int"), detail))
        if number and "missing_numeric" in want:
            cells.append(_row("missing_numeric", label, rows, measure(F.count_if(v.isNull()))))
        if (text or number) and "implicit_nulls" in want:
            hit = measure(F.count_if(nulls.implicit_null(df, name)))
            cells.append(_row("implicit_nulls", label, rows, hit))
        if number and "outliers" in want:
            x = v.cast("double")
            i = numbers.index(name)
            low, high = F.col("__fences")[f"lo_{i}"], F.col("__fences")[f"hi_{i}"]
            hit = measure(F.count_if((x < low) | (x > high)))
            cells.append(_row("outliers", label, rows, hit))
        if not text:
            continue
        if "missing_text" in want:
            cells.append(_row("missing_text", label, rows, measure(F.count_if(v.isNull() | (tx.trim_text(v) == "")))))
        if "outer_spaces" in want:
            cells.append(_row("outer_spaces", label, rows, measure(F.count_if(v != tx.trim_text(v)))))
        if "encoding" in want:
            bad = tx.looks_misdecoded(v) | (v != tx.remove_control_chars(v))
            cells.append(_row("encoding", label, rows, measure(F.count_if(bad))))
        if "right_types" in want:
            n = measure(F.count(v))
            number_n = measure(F.count(nm.to_number(v)))
            date_n = measure(F.count(dt.parse_date(v)))
            better = (
                F.when(n == 0, "string")
                .when(number_n >= n * 0.9, "double")
                .when(date_n >= n * 0.9, "timestamp")
                .otherwise("string")
            )
            cells.append(_row("right_types", label, F.lit(1), (better != "string").cast("int"), better))
        if "date_formats" in want:
            seen = F.array(*[measure(F.count(dt.parse_date(v, f))) for f in ("br_format", "iso_format")])
            cells.append(_row("date_formats", label, F.lit(1), _minority(seen)[1], _minority(seen)[2]))
        if "separators" in want:
            bare = nm.bare_amount(v)
            shapes = (nm.DOT_DECIMAL, nm.COMMA_DECIMAL, nm.SPACE_THOUSANDS)
            amount = bare.rlike("^[0-9., ]+$")
            seen = F.array(*[measure(F.count_if(amount & bare.rlike(s))) for s in shapes])
            cells.append(_row("separators", label, rows, _minority(seen)[0], _minority(seen)[2]))
    for r in [*rules, *[x for x in relations if isinstance(x, Rule)]]:
        check = "row_rules" if r in rules else "relations"
        if check in want:
            broken = measure(F.count_if(~F.expr(r.condition)))
            cells.append(_row(check, F.lit(r.name), rows, broken, F.lit(r.condition)))
    one = marked.agg(*aggs)
    if not cells:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return _rows(one, cells)


def _minority(counts: Column) -> tuple[Column, Column, Column]:
    """Values outside the commonest format, whether there are any, and the counts as text."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rest = total - F.array_max(counts)
    return rest, (rest > 0).cast("int"), F.array_join(counts.cast("array<string>"), "/")


def audit_names(names: DataFrame, checks: Sequence[str] = ("naming_pattern", "special_name_chars"), column: str = "name") -> DataFrame:
    """The naming checks over names held as data (one row a name and check), as ``audit`` makes them of a schema."""
    return _naming(names.select(F.col(st.quoted(column)).alias("name")).filter("name is not null"), set(checks))


def _naming(names: DataFrame, want: set[str]) -> DataFrame:
    names = names.withColumn("style", nn.name_style(F.col("name")))
    styles = names.groupBy("style").agg(F.count("*").alias("n"))
    # a known style before names that follow none, then the commonest
    rank = F.struct((F.col("style") == "other").alias("last"), (-F.col("n")).alias("n"), "style")
    marked = names.withColumn("common", styles.agg(F.min(rank)["style"].alias("style")).scalar())
    odd = nn.needs_standardizing(F.col("name")) | nn.has_accents(F.col("name")) | F.col("name").contains("$")
    cells = []
    if "naming_pattern" in want:
        other = (F.col("style") != F.col("common")).cast("int")
        cells.append(_row("naming_pattern", F.col("name"), F.lit(1), other, F.concat_ws("/", "style", "common")))
    if "special_name_chars" in want:
        cells.append(_row("special_name_chars", F.col("name"), F.lit(1), odd.cast("int")))
    return _rows(marked, cells)


def _case(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Values that differ from another only by case, from the table of distinct values."""
    # counted under digests: whole texts stay where they are
    cells = [F.struct(F.lit(c).alias("column"), *[F.md5(v.cast("binary")).alias(n) for n, v in (("value", w), ("low", F.lower(w)))]) for c in texts for w in (st.present(df, c),)]
    values = df.select(F.inline(F.array(*cells))).groupBy("column", "value", "low").agg(F.count("*").alias("n"))
    folded = values.groupBy("column", "low").agg(F.count("value").alias("k"), F.sum("n").alias("n"))
    found = folded.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("bad")
    )
    return _rows(found, [_row("case", F.col("column"), F.col("rows"), F.col("bad"), F.lit("distinct values"))])


def _relation(df: DataFrame, r: Determines | Exists) -> DataFrame:
    if isinstance(r, Determines):
        # distinct pairs first: counting parents then touches each pair once
        pairs = df.select(st.quoted(r.child), st.quoted(r.parent)).filter(
            F.col(st.quoted(r.child)).isNotNull() & F.col(st.quoted(r.parent)).isNotNull()
        )
        parents = pairs.distinct().groupBy(st.quoted(r.child)).agg(F.count("*").alias("k"))
        one = parents.agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("bad"))
        return _rows(one, [_row("relations", F.lit(r.child), F.col("n"), F.col("bad"), F.lit(f"determines {r.parent}"))])
    # counted per value before the join: a hot value is one row
    present = df.select(F.col(st.quoted(r.column)).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    known = r.other.select(F.col(st.quoted(r.key)).alias("k")).distinct()
    joined = present.join(known, F.col("v") == F.col("k"), "left")
    one = joined.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("bad"),
    )
    return _rows(one, [_row("relations", F.lit(r.column), F.col("n"), F.col("bad"), F.lit(f"exists in {r.key}"))])


# around the checks


def weight(priority: Column) -> Column:
    out = F.lit(UNKNOWN_ITEM)
    for name, level in PRIORITY.items():
        out = F.when(priority == name, F.lit(level)).otherwise(out)
    return out


def by_priority(rows: DataFrame, min_priority: str = "medium") -> DataFrame:
    return rows.filter(weight(F.col("priority")) >= PRIORITY.get(min_priority, UNKNOWN_MINIMUM))


def by_category(rows: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    return rows.filter(F.col("category").isin(list(categories))) if categories else rows


def group_report(rows: DataFrame) -> DataFrame:
    """Rows numbered within their category, with the category's size and worst rate."""
    within = Window.partitionBy("category")
    order = within.orderBy("check_id", F.coalesce("column", F.lit("")), "detail")
    return rows.select(
        "category",
        F.row_number().over(order).alias("number"),
        "check_id",
        "column",
        "priority",
        "n_violations",
        F.count("*").over(within).alias("n_items"),
        F.max("rate").over(within).alias("worst_rate"),
    )


def quality_score(rows: DataFrame) -> DataFrame:
    """One row: the pass rates weighted by priority as 0-100, its band, and the share of clean items."""
    w = weight(F.col("priority"))
    passed = 1 - F.least(F.col("rate"), F.lit(1.0))
    return rows.agg(
        F.coalesce(100 * F.sum(w * passed) / F.nullif(F.sum(w), F.lit(0)), F.lit(0.0)).alias("score"),
        F.coalesce(F.avg((F.col("n_violations") == 0).cast("double")), F.lit(0.0)).alias("success_rate"),
        F.count("*").alias("n_items"),
    ).withColumn("band", band(F.col("score")))


def gate(rows: DataFrame, min_score: float = MIN_SCORE, min_success: float = MIN_SUCCESS) -> DataFrame:
    """One row ``(passed, reasons)``."""
    s = quality_score(rows)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_items") == 0, F.lit("no checks ran")),
            F.when(F.col("score") < min_score, F.lit("low score")),
            F.when(F.col("success_rate") < min_success, F.lit("low success rate")),
        )
    )
    return s.select((F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"), "score", "success_rate")


def improvement(before: DataFrame, after: DataFrame, target: float = TARGET_SCORE) -> DataFrame:
    """One row: score before, after, the gain, and whether the target is met."""
    b, a = (quality_score(x).select("score").scalar() for x in (before, after))
    return before.sparkSession.range(1).select(b.alias("original"), a.alias("final")).select(
        "original",
        "final",
        (F.col("final") - F.col("original")).alias("gain"),
        F.lit(target).alias("target"),
        (F.col("final") >= target).alias("target_met"),
    )
