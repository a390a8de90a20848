"""Duplicates: exact, by key, similar, and their consolidation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions.text import clean_aggressive
from dqengine.operators import stats as st
from dqengine.session import match_keys, materialize


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per key (``first`` or ``last`` in the given order), or none of a repeated key (``False``)."""
    keys = list(subset or df.columns)
    if keep is False:
        return _only_single(df, keys)
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first', 'last' or False")
    if len(keys) == len(df.columns):
        return df.dropDuplicates()
    if not order_by:
        if keep == "last":
            raise ValueError("keep='last' needs order_by: rows of a DataFrame have no order")
        return df.dropDuplicates(keys)
    order = [F.col(st.quoted(c)).desc() if keep == "last" else F.col(st.quoted(c)).asc() for c in order_by]
    # rank = 1 is cut per task before the shuffle, so a hot key sends one row per task
    rank = F.row_number().over(Window.partitionBy(*map(st.quoted, keys)).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def _only_single(df: DataFrame, keys: list[str]) -> DataFrame:
    # grouped, not windowed: a hot key is counted map-side and never gathered
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(st.quoted(c)) for c in rest]) if rest else F.lit(None)
    grouped = df.groupBy(*map(st.quoted, keys)).agg(F.count("*").alias("__n"), F.any_value(row).alias("__row"))
    columns = [F.col("__row")[c].alias(c) if c in rest else F.col(st.quoted(c)) for c in df.columns]
    return grouped.filter("__n = 1").select(*columns)


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Every repeated key with its count."""
    keys = list(subset or df.columns)
    return df.groupBy(*map(st.quoted, keys)).agg(F.count("*").alias("count")).filter("count > 1")


def duplicate_totals(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct keys, rows that removing duplicates would take away."""
    keys = list(subset or df.columns)
    groups = df.groupBy(*map(st.quoted, keys)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("n_removed"),
    )


def deletions(text: Column, times: int) -> Column:
    """The text and every text left by deleting up to ``times`` characters."""
    found = F.array(text)
    for _ in range(times):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, _one_deleted))))
    return found


def _one_deleted(s: Column) -> Column:
    return F.when(
        F.length(s) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        ),
    ).otherwise(F.array().cast("array<string>"))


# Longer texts meet on segments, not on deletion variants.
LONG_TEXT = 64


def _segment(length: Column, count: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and size of piece ``i`` of ``count`` even pieces; the last ones take what is left over."""
    base, rest = F.floor(length / count).cast("int"), F.pmod(length, F.lit(count))
    return base * i + F.greatest(rest - (count - i), F.lit(0)), base + (F.lit(i) >= count - rest).cast("int")


def segment_keys(text: Column, times: int) -> Column:
    """Keys of the ``times`` + 1 segments of a text, one of which ``times`` edits leave whole."""
    length = F.length(text)
    parts = [(i, *_segment(length, times + 1, i)) for i in range(times + 1)]
    return F.array(*[F.xxhash64(length, F.lit(i), F.substring(text, start + 1, size)) for i, start, size in parts])


def probe_keys(text: Column, times: int) -> Column:
    """Keys of all segments that a text of at most this length within ``times`` edits can share with this one."""
    length = F.length(text)
    found = []
    for shorter in range(times + 1):
        for i in range(times + 1):
            start, size = _segment(length - shorter, times + 1, i)
            for shift in range(-times, times + 1):
                at = start + shift
                key = F.xxhash64(length - shorter, F.lit(i), F.substring(text, at + 1, size))
                found.append(F.when((at >= 0) & (at + size <= length), key))
    return F.array_distinct(F.array_compact(F.array(*found)))


def _long_pairs(heads: DataFrame, block: list[str], times: int) -> DataFrame:
    """``(id_a, id_b, distance)`` of distinct long texts within ``times`` edits.

    One of ``times`` + 1 segments of the shorter text stands unchanged in the longer one, at most ``times``
    places away: a few keys a text whatever its length, and no pair is missed. Keys travel without the texts.
    """
    own = heads.withColumn("mark", F.xxhash64("t"))
    keyed = own.select(*block, "head", "mark", F.explode(segment_keys(F.col("t"), times)).alias("key"))
    probes = own.select(*block, "head", "mark", F.explode(probe_keys(F.col("t"), times)).alias("key"))
    met = match_keys(
        probes.withColumnsRenamed({"head": "id_a", "mark": "mark_a"}), keyed.withColumnsRenamed({"head": "id_b", "mark": "mark_b"}).hint("merge"), [*block, "key"]
    ).filter("id_a != id_b")
    swap = F.col("id_a") > F.col("id_b")
    sides = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("id_b", "id_a"), ("mark_b", "mark_a"), ("id_a", "id_b"), ("mark_a", "mark_b"))]
    pairs = materialize(met.select(*sides).distinct())
    texts = own.select("head", "mark", "t").distinct()
    for side in "ab":
        pairs = pairs.join(texts.withColumnsRenamed({"head": f"id_{side}", "mark": f"mark_{side}", "t": f"t_{side}"}).hint("merge"), [f"id_{side}", f"mark_{side}"])
    return pairs


def fuzzy_duplicates(
    df: DataFrame,
    id_col: str,
    column: str,
    max_distance: int = 1,
    block: Sequence[str] = (),
    normalize: bool = True,
) -> DataFrame:
    """Links ``(id_a, id_b, distance)`` between records whose texts are similar.

    Equal texts are first grouped: each record links to the least id of its
    text (distance 0), so a text held by a third of all rows costs one link per
    row. Distinct texts within ``max_distance`` edits then meet on a shared
    deletion variant: two such texts always share one, and texts sharing one are
    at most twice as far apart, so the join emits little that is not an answer.
    Meant for names and codes; the variants grow with length to the power of
    ``max_distance``.
    """
    block = list(block)
    text = F.col(st.quoted(column))
    text = clean_aggressive(text) if normalize else text
    base = df.select(*block, F.col(st.quoted(id_col)).alias("id"), text.alias("t")).filter("t is not null")
    heads = base.groupBy(*block, "t").agg(F.min("id").alias("head"))
    # a fixed number of parts: each head grows into many variants
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = materialize(heads.repartition(partitions, "t"))
    copies = (
        match_keys(base, heads, [*block, "t"]).filter("id != head").select(F.col("head").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    )
    # the hash of a variant is the join key: chance meetings fall to the distance test
    shortened = F.transform(deletions(F.col("t"), max_distance), lambda v: F.xxhash64(v))
    variants = heads.filter(F.length("t") <= LONG_TEXT).select(*block, "t", "head", F.explode(F.array_distinct(shortened)).alias("variant"))
    left = variants.withColumnsRenamed({"t": "t_a", "head": "id_a"})
    right = variants.withColumnsRenamed({"t": "t_b", "head": "id_b"})
    # size estimates do not see how far heads grow, so a broadcast is ruled out
    met = match_keys(left, right.hint("merge"), [*block, "variant"]).filter("id_a < id_b")
    met = met.select("id_a", "id_b", "t_a", "t_b")
    # a pair may lie on both sides of the limit
    long = heads.filter(F.length("t") > LONG_TEXT - max_distance)
    if not long.isEmpty():
        met = met.unionByName(_long_pairs(long, block, max_distance).select("id_a", "id_b", "t_a", "t_b"))
    near = (
        met.withColumn("distance", F.levenshtein("t_a", "t_b", max_distance))
        .filter(F.col("distance") >= 0)
        .select("id_a", "id_b", "distance")
        .distinct()
    )
    return near.unionByName(copies)


def components(links: DataFrame, left: str = "id_a", right: str = "id_b", rounds: int = 60) -> DataFrame:
    """Rows ``(id, component)``: linked ids share the least id among them.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    keeps the edges of a node as a grouped minimum and a join, so a node with
    very many links is never gathered, and a long chain takes few rounds. Each
    round is written to the checkpoint folder. Merge joins only: both sides grow
    with the links, and small tables of many rounds would pile up in the driver.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u != v")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(both, F.col("v") > F.col("u"))
        edges = materialize(_star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None))
        # an order-free mark of the edge set: equal marks twice in a row end the loop
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    found = nodes.withColumnRenamed("u", "node").join(roots.hint("merge"), F.col("node") == F.col("id"), "left")
    return found.select(F.col("node").alias("id"), F.coalesce("root", "node").alias("component"))


def _star(edges: DataFrame, keep: Column | None) -> DataFrame:
    """Link the neighbours of each node (those kept, and the node itself) to its least neighbour."""
    # written first: a join reading an aggregate directly is not split by adaptive execution when a hub is hot
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    joined = edges.join(least.hint("merge"), F.col("u") == F.col("w"))
    linked = (joined.filter(keep) if keep is not None else joined).select(F.col("v").alias("a"), "m")
    if keep is None:
        linked = linked.union(least.select(F.col("w").alias("a"), "m"))
    return linked.filter("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def consolidate(
    df: DataFrame,
    id_col: str,
    links: DataFrame,
    survivor_by: Sequence[str] = (),
) -> DataFrame:
    """One record per linked group, gaps filled from the others; unlinked records stay.

    The survivor is the record with most present values, then the first by
    ``survivor_by`` and id. Each column takes the value of the best record that
    has one: an aggregate per column, combined map-side.
    """
    groups = components(links)
    joined = df.join(groups.withColumnRenamed("id", "__id"), F.col(st.quoted(id_col)) == F.col("__id"), "left")
    filled = F.lit(0)
    for c in df.columns:
        filled = filled + st.present(df, c).isNotNull().cast("int")
    best = F.struct((-filled).alias("gaps"), *[F.col(st.quoted(c)) for c in survivor_by], F.col(st.quoted(id_col)).alias("id"))
    ranked = joined.select(
        F.coalesce("component", F.col(st.quoted(id_col))).alias("__component"),
        best.alias("__best"),
        *[st.present(df, c).alias(c) for c in df.columns],
    )
    picks = [
        F.min(F.when(F.col(st.quoted(c)).isNotNull(), F.struct("__best", F.col(st.quoted(c)).alias("v"))))["v"].alias(c)
        for c in df.columns
        if c != id_col
    ]
    grouped = ranked.groupBy("__component").agg(F.min("__best")["id"].alias(id_col), *picks, F.count("*").alias("n_records"))
    return grouped.select(*df.columns, "n_records")
