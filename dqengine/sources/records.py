"""Records that run over several lines of one file, found in parallel.

A file is read in its blocks. Whether a place lies inside a quoted text, and how deep inside brackets, depends
on all that stands before it; but each block's effect on that is one small row, so a scan over
the blocks tells each block how it begins, and every record is then cut by the task that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.session import materialize, scratch_path, size_checked

BLOCK = ["file", "block"]
# Bytes of the files for each task that sorts or gathers pieces, so that no task's share grows with the input.
TASK_BYTES = 8 << 20


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``(value, file, block, at)``: the pieces of every file between separators, numbered within their block."""
    pieces = spark.read.option("lineSep", sep).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return pieces.select("value", *place, F.monotonically_increasing_id().alias("at"))


def _tasks(spark: SparkSession, path: str) -> int:
    """Tasks for all pieces of the files, by the sizes that the file system names."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return max(1, -(-(size or 0) // TASK_BYTES))


def _running(c: Column) -> Column:
    """Sum of all earlier rows of the block."""
    before = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(before), F.lit(0))


def _entering(blocks: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """What every block begins with: sums over the earlier blocks of its file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in columns.items()})


def _joined(pieces: DataFrame, sep: str, tasks: int) -> DataFrame:
    """``(file, record, value)``: records of one piece as they are, longer ones put together in order."""
    sizes = pieces.filter("not whole").repartition(tasks, "file", "record").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts")
    )
    long = sizes.select("file", "record", F.array_join(F.transform("parts", lambda p: p["value"]), sep).alias("value"))
    return pieces.filter("whole").select("file", "record", "value").unionByName(long)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, value)``: records of CSV files whose quoted texts hold line breaks; ``record`` counts from 0 in each file.

    A line begins a record where the quotes before it are balanced. Most records are one line and are not shuffled
    again; only the lines of the others meet.
    """
    tasks = _tasks(spark, path)
    lines = _pieces(spark, path, "\n").repartition(tasks, *BLOCK)
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    lines = lines.withColumn("odd", odd)
    lines = lines.withColumn("inside", _running(F.col("odd")) % 2)
    # the count of records for either way the block may begin
    counts = {f"n{s}": _running((F.col("inside") == s).cast("long")) + (F.col("inside") == s).cast("long") for s in (0, 1)}
    lines = materialize(lines.withColumns(counts))
    blocks = lines.groupBy(*BLOCK).agg(F.sum("odd").alias("odd"), F.max("n0").alias("all0"), F.max("n1").alias("all1"))
    blocks = _entering(blocks, {"entry": F.col("odd")}).withColumn("entry", F.col("entry") % 2)
    blocks = _entering(blocks, {"first": F.when(F.col("entry") == 0, F.col("all0")).otherwise(F.col("all1"))})
    known = size_checked(blocks.select(*BLOCK, "entry", "first"))
    placed = lines.join(known, BLOCK)
    number = F.col("first") + F.when(F.col("entry") == 0, F.col("n0")).otherwise(F.col("n1")) - 1
    whole = (F.col("inside") == F.col("entry")) & (F.col("odd") == 0)
    found = _joined(placed.select("file", "block", "at", "value", number.alias("record"), whole.alias("whole")), "\n", tasks)
    return found.withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str], sep: str) -> DataFrame:
    """All columns as texts; a record of another width is an error, as in the reader's strict mode."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = csv_records(spark, path).filter((F.col("record") > 0) & (F.trim("value") != ""))
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep, "escape": '"', "mode": "FAILFAST"})
    return rows.select(parsed.alias("row")).select("row.*")


def array_elements(spark: SparkSession, path: str) -> DataFrame | None:
    """``(file, record, value)``: the objects of files that hold one JSON array each; None for files of another kind.

    Files are cut at closing braces. How far a piece goes in and out of brackets is counted for both cases, that it begins
    outside or inside of a text. An element ends with the brace that leads back to depth 1.
    """
    pieces = _pieces(spark, path, "}")
    # a flag and a number: hashed, where texts would be sorted
    heads = pieces.filter("block = 0").groupBy("file").agg(F.min_by(F.col("value").rlike(r"^\s*\["), "at").alias("array"))
    if not heads.select(F.bool_and("array")).first()[0]:
        return None
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(bare, '"', -1)

    def turns(start: int) -> Column:
        """Brackets opened less those closed in every second part: outside of texts, if these begin so."""
        kept = F.array_join(F.filter(parts, lambda x, i: i % 2 == start), "")
        opened = F.length(kept) - F.length(F.translate(kept, "{[", ""))
        return opened - (F.length(kept) - F.length(F.translate(kept, "}]", "")))

    # the closing brace itself counts where the piece ends outside of a text; a file's last piece has none, so it is mended below
    odd = F.pmod(F.size(parts) - 1, F.lit(2))
    pieces = pieces.withColumn("odd", odd).withColumn("d0", turns(0) - (1 - F.col("odd"))).withColumn("d1", turns(1) - F.col("odd"))
    tasks = _tasks(spark, path)
    pieces = pieces.repartition(tasks, *BLOCK).withColumn("inside", _running(F.col("odd")) % 2)
    own = lambda s: F.when(F.col("inside") == s, F.col("d0")).otherwise(F.col("d1"))
    pieces = pieces.withColumn("t0", own(0)).withColumn("t1", own(1))
    pieces = materialize(pieces.withColumn("r0", _running(F.col("t0")) + F.col("t0")).withColumn("r1", _running(F.col("t1")) + F.col("t1")))
    blocks = pieces.groupBy(*BLOCK).agg(F.sum("odd").alias("odd"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    blocks = _entering(blocks, {"entry": F.col("odd")}).withColumn("entry", F.col("entry") % 2)
    blocks = _entering(blocks, {"deep": F.when(F.col("entry") == 0, F.col("t0")).otherwise(F.col("t1"))})
    placed = pieces.join(size_checked(blocks.select(*BLOCK, "entry", "deep")), BLOCK)
    depth = F.col("deep") + F.when(F.col("entry") == 0, F.col("r0")).otherwise(F.col("r1"))
    # outside of a text after the piece, and back in the array
    ends = (((F.col("inside") + F.col("entry") + F.col("odd")) % 2 == 0) & (depth == 1)).cast("long")
    placed = placed.select("file", "block", "at", "value", ends.alias("ends")).repartition(tasks, *BLOCK)
    before = F.lag("ends").over(Window.partitionBy(*BLOCK).orderBy("at"))
    placed = materialize(placed.withColumn("n", _running(F.col("ends"))).withColumn("before", before))
    counts = _entering(placed.groupBy(*BLOCK).agg(F.sum("ends").alias("ends")), {"first": F.col("ends")})
    numbered = placed.join(size_checked(counts.select(*BLOCK, "first")), BLOCK)
    numbered = numbered.withColumn("record", F.col("first") + F.col("n"))
    # a record of one piece ends there, and no piece before it is its own
    numbered = numbered.withColumn("whole", (F.col("ends") == 1) & (F.coalesce("before", F.lit(0)) == 1))
    found = _joined(numbered, "}", tasks)
    last = found.groupBy("file").agg(F.max("record").alias("last"))
    found = materialize(found.join(size_checked(last), "file"))
    closing, element = r"^\s*\]\s*$", r"(?s)^\s*[\[,]\s*(\{.*)$"
    empty = r"^\s*\[\s*\]\s*$"
    good = F.when(F.col("record") == F.col("last"), F.col("value").rlike(closing) | ((F.col("last") == 0) & F.col("value").rlike(empty)))
    good = good.otherwise(F.col("value").rlike(element) & (F.col("value").rlike(r"^\s*\[") == (F.col("record") == 0)))
    if not found.filter(~good).isEmpty():
        raise ValueError(f"{path} does not hold an array of objects")
    return found.filter(F.col("record") < F.col("last")).select("file", "record", F.concat(F.regexp_extract("value", element, 1), F.lit("}")).alias("value"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of files that hold one JSON array of objects each, or None; many tasks read one file."""
    found = array_elements(spark, path)
    if found is None:
        return None
    # raw line breaks can only stand between tokens
    lines = scratch_path(spark, "elements")
    found.select(F.translate("value", "\n\r", "  ").alias("value")).write.text(lines)
    return spark.read.option("mode", "FAILFAST").json(lines)
