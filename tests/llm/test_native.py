"""Operators 4, 7 and 8 against brute force and SQL."""

import hashlib
import math
import re

import pytest
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F
from samples import EDGES, labels, table

from dqengine.llm import line_dedup, mixing, quality_rules, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    assert difference(got, duck_rows(connect(FOLDER), queries.ORACLES[name])) is None


def python_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


REPEATS = [
    (20, "a b c d e f g h " * 3),
    (21, " ".join("x" for _ in range(9))),
    (22, "p q r s t u v w z p q r s t u v w\n#### | <a> | $5\nsame\nsame\n \n \nsame "),
]


def test_measures(spark):
    rows = EDGES + REPEATS + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = quality_rules.measures(table(spark, rows)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == sorted(python_measures(t) for _, t in rows)


def test_binomial_is_exact(spark):
    cases = [(k, n, p) for p in (0.02, 0.3) for n in (1, 30, 400, 5000) for k in (0, 1, int(n * p / 2), int(n * p) - 1) if 0 <= k < n * p]
    for p in (0.02, 0.3):
        rows = [(k, n) for k, n, q in cases if q == p]
        frame = spark.createDataFrame(rows, "k long, n long")
        for r in frame.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), p).alias("p")).collect():
            want = sum(math.comb(r["n"], i) * (int(p * 100) ** i) * ((100 - int(p * 100)) ** (r["n"] - i)) for i in range(r["k"] + 1)) / 100 ** r["n"]
            assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_bound_false_rejections(spark):
    rules = (quality_rules.Rule("share", "v", (0.9, 0.5, 0.1)),)
    good = [("s", 0.95 if i < 1 else 0.6 if i < 6 else 0.2 if i < 300 else 0.0) for i in range(1000)] + [("tiny", 0.0)] * 20
    chosen = quality_rules.select_cutoffs(spark.createDataFrame(good, "stratum string, v double"), rules, risk=0.02)
    # 1 and 6 of 1000 above are provably below 2 %, 300 are not; 20 rows prove nothing
    assert [tuple(r) for r in chosen.collect()] == [("s", "share", 0.5)]


def test_quality_rules_edges(spark):
    docs = table(spark, EDGES + REPEATS)
    marks = labels(spark, [(4, 1, 0), (5, 1, 0), (5, 1, 0), (6, None, 0), (99, 1, 1)])
    got = quality_rules.quality_rules(docs, marks).collect()
    assert len(got) == len(EDGES + REPEATS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["base_failed"] and not by_id[1]["kept"] and by_id[5]["n_words"] == 60_000
    assert not quality_rules.quality_rules(docs.limit(0), marks.limit(0)).collect()
    assert {r["kept"] for r in quality_rules.quality_rules(docs, marks.limit(0)).collect() if not r["base_failed"]} <= {True}


def python_lines(rows):
    holders = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_edges(spark):
    rows = EDGES + [(30, "nobody knows this id but the text is here\n" * 3), (31, "É" * 10 + "\n" + "é" * 10), (32, "É" * 10)]
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == python_lines(rows)
    three = line_dedup.deduplicate_lines(table(spark, [(i, "shared by three") for i in range(3)] + [(9, "only by two!!"), (8, "only by two!!")]), min_docs=3)
    assert {r["doc_id"] for r in three.collect() if r["n_dropped"]} == {1, 2}
    assert not line_dedup.deduplicate_lines(table(spark, [])).collect()


def test_mixing_edges(spark):
    docs = table(spark, EDGES)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(EDGES) and set(docs.columns) < set(mixed[0].asDict())
    assert all(0 <= r["__copies"] <= 2 for r in mixed)
    assert sorted(r["__copies"] for r in mixed) == sorted(r["__copies"] for r in mixing.mix(docs).collect())
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.count() == sum(r["__copies"] for r in mixed)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix(table(spark, [(1, None), (2, "")])).agg(F.sum("__copies")).first()[0] == 0


def test_rows_without_id_meet_their_targets(spark):
    """A third of a source has no id: its documents draw apart from each other."""
    rows = [(None if i % 3 == 0 else i, f"text {i} of ten words or so, no more than that") for i in range(6000)]
    mixed = mixing.mix(table(spark, rows, clash=False).withColumn("source", F.lit("one")))
    row = mixed.agg(F.sum(F.col("__size") * F.col("__copies")).alias("taken"), F.max("__target").alias("target")).first()
    assert abs(row["taken"] / row["target"] - 1) < 0.03
    again = mixing.mix(table(spark, rows, clash=False).withColumn("source", F.lit("one")))
    assert sorted(r["__copies"] for r in mixed.filter("doc_id is null").collect()) == sorted(r["__copies"] for r in again.filter("doc_id is null").collect())


def test_targets_are_shared_by_weight(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 0), (None, 400)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    assert sum(got.values()) == pytest.approx(1.5 * 1460)
    open_ = [s for s, n in sizes if got[s] < 2 * n - 1e-6]
    assert all(got[s] <= 2 * n + 1e-6 for s, n in sizes) and got["a"] == 20 and got["c"] == 100
    assert len({round(got[s] / weight[s], 6) for s in open_}) == 1


def test_kept_text_hash(spark):
    row = queries.op7_line_dedup(spark, FOLDER).filter("n_dropped = 0").first()
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
