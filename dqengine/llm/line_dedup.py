"""Drop lines that many documents share (dealt operator 7, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BLANK_CHARS, ascii_lower, stored


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK_CHARS)))


def deduplicate_lines(
    docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return (doc_id, n_lines, n_dropped, kept_text), one row per input row.

    Lines are exploded, normalised (blanks stripped at both ends, A-Z lowered) and
    hashed to 128 bits. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses all its lines except those of the smallest doc_id that
    has it. The text is put together again by position; only positions to drop
    travel, never the lines.

    Null or empty text is one empty line. Rows with the same id are one document for
    counting. Rows without an id are together one document that comes after all others.
    A line repeated within one document counts once. Extra columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("text"))
    owner = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    lines = base.select(
        "doc_id", "row", owner.alias("owner"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "row", "owner", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "row", "owner", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2")
    )
    # distinct documents first: a line in every document is then counted by many tasks
    held = keyed.groupBy("k1", "k2", "owner").agg(F.lit(1).alias("one"))
    shared = held.groupBy("k1", "k2").agg(F.count("one").alias("n_docs"), F.min("owner").alias("keeper"))
    # written before the join, so that adaptive execution can split a line with very many rows
    shared = stored(shared.filter(F.col("n_docs") >= min_docs).select("k1", "k2", "keeper"), "shared-lines")
    gone = keyed.join(shared, ["k1", "k2"]).filter(F.col("owner") != F.col("keeper"))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(
        F.collect_set("pos").alias("__gone")
    )
    joined = base.join(
        gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left"
    )
    parts = joined.select("doc_id", "text", "__gone", F.split("text", "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return parts.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
