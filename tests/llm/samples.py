"""Rows that every operator must stand: nulls, blanks, long texts, repeats, clashing columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\r\n \x0b\x0c "),
    (4, "word"),
    (5, LONG),
    (6, LONG),
    (7, "Ça ÉTÉ übung ñandú 日本語 \U0001f600 text"),
    (8, "one line of text here\nONE LINE OF TEXT HERE \nlast"),
    (9, "one line of text here\n\n"),
    (9, "one line of text here\n\n"),
    (None, "nobody knows this id but the text is here"),
    (-10, "a negative id comes first of all"),
]
CLASHES = "row print size words key label part pos line lines score kept word item term n owner target copies".split()


def table(spark: SparkSession, rows, clash: bool = True) -> DataFrame:
    """Documents with null language and source among others, and columns named like the operators' own."""
    full = [(i, t, ["en", None, "fr"][k % 3], ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in CLASHES}) if clash else docs


def labels(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("label", F.lit("y"))
