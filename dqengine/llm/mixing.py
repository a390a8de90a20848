"""Mix sources to target weights by repeating documents (dealt operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, ranked, stored

SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document's id, or on its text where it has no id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(F.encode(text, "utf-8")), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of each source from a table (source, source_size).

    Sources take ``weights`` in turn, in code point order, null last. They share
    ``share`` times all sizes by weight; a target stops at ``most`` times its source's
    size and the excess is shared again among the others. Only sums come to the driver.
    """
    if share > most:
        raise ValueError("share cannot exceed most: no mix could reach it")
    listed = ranked(sizes, [F.col("source").isNull(), F.col("source")], "__rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    listed = stored(listed.select("source", "source_size", turn.alias("__w")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    level, capped_before = 0.0, -1
    while True:
        over = F.col("__w") * F.lit(level) > cap
        row = listed.agg(
            F.sum("source_size").alias("total"),
            F.count(F.when(over, 1)).alias("capped"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("__w"))).alias("open"),
        ).first()
        # the level only rises, so a source once above its cap stays there
        if row["capped"] == capped_before or not row["open"]:
            break
        level, capped_before = (share * row["total"] - row["fixed"]) / row["open"], row["capped"]
    return listed.select("source", "source_size", F.least(F.col("__w") * F.lit(level), cap).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Add ``__size``, ``__source_size``, ``__target`` and ``__copies`` to every document.

    A source's rate is its target over its size; each document is taken floor(rate)
    times and once more when its seeded draw falls below the fraction. Null source is
    a source of its own; null or blank text has size 0; a source of size 0 has rate 0
    (none of its documents is taken); rows that share an id share their draw, rows without one
    draw by their text; an empty table stays empty. Other columns pass through untouched.
    """
    sized = docs.withColumn("__size", words_in(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("__size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    extra = (draw(F.col(doc_id), F.col(text), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("__copies", (F.floor(rate) + extra).cast("int"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own columns, each document as often as it is taken."""
    mixed = mix(docs, **options)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*docs.columns)
