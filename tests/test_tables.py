"""Operators on small tables with hot keys and gaps, against brute force."""

import datetime
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqengine.operators import aggregate as ag
from dqengine.operators import audit as au
from dqengine.operators import columns as cols
from dqengine.operators import clusters, dates, dedup, inverted, nulls, numeric, similar
from dqengine.operators import profile as pf
from dqengine.operators import retrieval as rt
from dqengine.operators import stats as st
from dqengine.operators import textjobs as tj


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group with one value; the rest spread; gaps and NaN."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(20)}"
        value = 5.0 if group == "hot" and rng.random() < 0.5 else rng.gauss(0, 100)
        rows.append((i, group if i % 50 else None, None if i % 11 == 0 else float("nan") if i % 13 == 0 else value))
    return rows


@pytest.fixture(scope="module")
def table(spark, skewed):
    return spark.createDataFrame(skewed, "id bigint, g string, v double").repartition(7)


def present(rows):
    return [v for _, _, v in rows if v is not None and v == v]


def test_quantiles_match_numpy(table, skewed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in st.quantile_table(table, ["v"], probs).collect()}
    assert got == pytest.approx({p: np.quantile(present(skewed), p) for p in probs})


def test_quantiles_with_coarse_sketches(table, skewed, monkeypatch):
    # brackets hold many values here, and the exact rank is still found
    monkeypatch.setattr(st, "SKETCH_ACCURACY", 20)
    got = {r["prob"]: r["value"] for r in st.quantile_table(table, ["v"], [0.25, 0.5, 0.9]).collect()}
    assert got == pytest.approx({p: np.quantile(present(skewed), p) for p in (0.25, 0.5, 0.9)})


def test_quantiles_by_group(table, skewed):
    groups = {}
    for _, g, v in skewed:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    got = {r["g"]: r["value"] for r in st.quantile_table(table, ["v"], [0.5], ["g"]).collect()}
    assert got == pytest.approx({g: np.quantile(v, 0.5) for g, v in groups.items()})


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id int, v double")
    assert st.quantile_table(empty, ["v"], [0.5]).collect() == []
    assert nulls.handle_nulls(empty, "v", "fill_median").collect()[0]["v"] is None


@pytest.mark.parametrize("strategy", ["fill_mean", "fill_median", "fill_mode"])
def test_fills_leave_no_gap(table, strategy):
    filled = nulls.handle_nulls(table, "v", strategy)
    assert filled.columns == table.columns
    assert filled.filter(st.present(filled, "v").isNull()).count() == 0
    assert filled.count() == table.count()


def test_group_fill_falls_back_to_the_whole(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 4.0), (None, None)], "g string, v double")
    got = Counter((r["g"], r["v"]) for r in nulls.handle_nulls(df, "v", "fill_mean", by=["g"]).collect())
    assert got == Counter([("a", 1.0), ("a", 1.0), ("b", 2.5), (None, 4.0), (None, 4.0)])


def test_mode_ties_and_nothing(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, t string")
    out = nulls.fill_statistics(df, {"s": "fill_mode", "t": "fill_mode"})
    assert Counter(r["s"] for r in out.collect()) == Counter(["b", "a", "a"])
    assert {r["t"] for r in out.collect()} == {"Unknown"}


def test_custom_fill_keeps_the_type(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert nulls.handle_nulls(df, "n", "fill_custom", "7").dtypes == [("n", "int")]
    with pytest.raises(ValueError):
        nulls.handle_nulls(df, "n", "fill_custom", "N/A")
    with pytest.raises(ValueError):
        nulls.handle_nulls(df, "n", "no_such_strategy")


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("strategy", ["fill_forward", "fill_backward"])
@pytest.mark.parametrize("limit", [None, 1, 2])
def test_ordered_fill_matches_pandas(table, skewed, by, strategy, limit):
    frame = pd.DataFrame(skewed, columns=["id", "g", "v"]).sort_values("id")
    series = frame.groupby("g", dropna=False)["v"] if by else frame["v"]
    want = series.ffill(limit=limit) if strategy == "fill_forward" else series.bfill(limit=limit)
    out = nulls.handle_nulls(table, "v", strategy, partition_by=by, order_by=["id"], limit=limit)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert len(got) == len(skewed)
    for i, v in zip(frame["id"], want):
        assert got[i] == v or (got[i] is None and v != v), i


def test_ordered_fill_needs_an_order(table):
    with pytest.raises(ValueError):
        nulls.handle_nulls(table, "v", "fill_forward")


@pytest.mark.parametrize("strategy", ["fill_forward", "fill_backward"])
@pytest.mark.parametrize("limit", [None, 2])
def test_ordered_fill_with_one_day_for_all_rows(spark, strategy, limit):
    """Ties are settled by the next order column, and then by the place in the input; no task gets them all."""
    rng = random.Random(2)
    rows = [("2024-01-01", f"k{i % 7:03d}" if i % 5 else None, i, None if rng.random() < 0.6 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "day string, k string, i long, v double").repartition(6, "i")
    frame = pd.DataFrame(rows, columns=["day", "k", "i", "v"]).sort_values(["day", "k", "i"], na_position="first")
    want = frame["v"].ffill(limit=limit) if strategy == "fill_forward" else frame["v"].bfill(limit=limit)
    out = nulls.handle_nulls(df, "v", strategy, order_by=["day", "k", "i"], limit=limit)
    got = {r["i"]: r["v"] for r in out.collect()}
    assert all(got[i] == v or (got[i] is None and v != v) for i, v in zip(frame["i"], want))
    # the day alone: the order of the input decides
    plain = spark.createDataFrame(rows, "day string, k string, i long, v double")
    out = nulls.handle_nulls(plain, "v", strategy, order_by=["day"], limit=limit)
    series = pd.Series([r[3] for r in rows])
    want = series.ffill(limit=limit) if strategy == "fill_forward" else series.bfill(limit=limit)
    got = {r["i"]: r["v"] for r in out.collect()}
    assert all(got[i] == v or (got[i] is None and v != v) for i, v in enumerate(want))


def test_normalize_nan_and_flat(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0), (float("nan"), None)], "a double, b double")
    for method, low in (("standard", -1.0), ("minmax", 0.0)):
        rows = [tuple(r) for r in numeric.normalize(df, ["a", "b"], method).collect()]
        assert rows == [(low, 0.0), (1.0, 0.0), (None, None)]


@pytest.mark.parametrize("action", ["flag", "null", "clip", "drop"])
def test_outliers(spark, action):
    df = spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    out = numeric.outliers_iqr(df, ["v"], action=action).collect()
    values = sorted((r["v"] for r in out), key=lambda v: (v is None, v))
    assert values == {
        "flag": [1, 2, 3, 4, 100, None],
        "null": [1, 2, 3, 4, None, None],
        "clip": [1, 2, 3, 4, 7.0, None],
        "drop": [1, 2, 3, 4, None],
    }[action]


def test_errors_modes(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert numeric.to_numeric(df, "v").dtypes == [("v", "double")]
    assert numeric.to_numeric(df, "v", errors="ignore").dtypes == [("v", "string")]
    assert dates.to_datetime(df, "v", errors="ignore").dtypes == [("v", "string")]
    with pytest.raises(Exception, match="cannot convert v: x"):
        numeric.to_numeric(df, "v", errors="raise").collect()
    assert numeric.to_numeric(df, "v", "keep_original").dtypes == [("v", "string")]


def test_invalid_dates_today(spark):
    df = spark.createDataFrame([("x",), ("01/02/2023",), (None,)], "d string")
    out = dates.invalid_dates(df, "d", "fill_today", today=datetime.date(2024, 1, 5)).collect()
    assert [r["d"] for r in out] == [datetime.datetime(2024, 1, 5), datetime.datetime(2023, 2, 1), None]
    kept = dates.invalid_dates(df, "d").count()
    assert kept == 2


# ------------------------------------------------------------ columns


def test_twin_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A B` int, `a-b` int, a_b_2 int")
    assert cols.standardize_names(df).columns == ["a_b", "a_b_2", "a_b_2_2"]
    with pytest.raises(ValueError):
        cols.standardize_names(df, ["nope"])


def test_duplicate_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (None, None, 2, None), (3, 3, 3, 4)], "a int, b int, c int, d int")
    assert cols.drop_duplicate_columns(df).columns == ["a", "c", "d"]


def test_optimize_types(spark):
    df = spark.createDataFrame([(1, 200, 40000, 2.0, 1.5, "x")], "a bigint, b bigint, c bigint, d double, e double, s string")
    assert [t for _, t in cols.optimize_types(df).dtypes] == ["tinyint", "smallint", "int", "bigint", "double", "string"]


def test_profile_of_nan(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (1.0, "a")], "v double, s string")
    rows = {r["name"]: r for r in pf.profile(df).collect()}
    assert rows["v"]["is_nullable"] and rows["v"]["unique_values"] == 1
    assert rows["v"]["min_value"] == rows["v"]["max_value"] == "1.0"
    assert [(x["value"], x["count"]) for x in rows["s"]["top_values"]] == [("a", 2), ("nan", 1)]
    guess = {r["name"]: r["unique_values"] for r in pf.profile(df, approx=True).collect()}
    assert guess == {"v": 1, "s": 1}


def test_top_values_of_long_texts(spark):
    texts = ["a" * 100] * 3 + ["b" * 100] * 2 + ["c", None, None, None, None]
    df = spark.createDataFrame([(t, 1) for t in texts], "s string, n int")
    got = [(r["value"], r["count"]) for r in pf.top_values(df, 3, ["s"]).orderBy("rank").collect()]
    assert got == [("nan", 4), ("a" * 100, 3), ("b" * 100, 2)]
    rows = {r["name"]: r for r in pf.profile(df).collect()}
    assert rows["s"]["unique_values"] == 3 and rows["s"]["top_values"][1]["value"] == "a" * 100


# ------------------------------------------------------------ duplicates


def test_keep_none_and_last(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert [tuple(r) for r in dedup.remove_duplicates(df, ["k"], False).collect()] == [(2, "c")]
    last = {tuple(r) for r in dedup.remove_duplicates(df, ["k"], "last", ["v"]).collect()}
    assert last == {(1, "b"), (2, "c"), (None, "e")}
    with pytest.raises(ValueError):
        dedup.remove_duplicates(df, ["k"], "last")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_fuzzy_finds_every_pair(spark, limit):
    rng = random.Random(3)
    texts = ["same"] * 40 + ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    links = dedup.fuzzy_duplicates(df, "id", "t", limit, normalize=False).collect()
    head = {}
    for i, t in enumerate(texts):
        head.setdefault(t, i)
    want = {(head[t], i, 0) for i, t in enumerate(texts) if head[t] != i}
    heads = sorted(head.items(), key=lambda x: x[1])
    for n, (a, i) in enumerate(heads):
        for b, j in heads[n + 1 :]:
            if 0 < distance(a, b) <= limit:
                want.add((i, j, distance(a, b)))
    assert {tuple(r) for r in links} == want
    assert len(links) == len(want)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)]  # a chain
    links += [(0, i) for i in range(1, 60)]  # a hot node
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(links, "id_a int, id_b int")
    got = {r["id"]: r["component"] for r in dedup.components(df).collect()}
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert got == want


def test_consolidate_fills_from_the_best(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, 5.0, "y"), (3, 7.0, None), (4, None, None)], "id int, v double, s string"
    )
    links = spark.createDataFrame([(1, 2), (1, 3)], "id_a int, id_b int")
    got = {tuple(r) for r in dedup.consolidate(df, "id", links).collect()}
    assert got == {(2, 5.0, "y", 3), (4, None, None, 1)}


# ------------------------------------------------------------ grouping


def test_transform_agg_with_missing_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    got = {tuple(r) for r in ag.transform_agg(df, ["g"], "v", "mean").collect()}
    assert got == {("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, 5.0)}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in ag.chart_data(df, "v", None, "histogram").collect()] == [(0, 2)]


# ------------------------------------------------------------ audit


def test_audit_priorities():
    assert "encoding" not in au.selected() and "encoding" in au.selected(min_priority="low")
    assert set(au.selected(["duplicates"], "high")) == {"exact_duplicates"}
    assert au.selected(min_priority="odd") == au.selected(min_priority="medium")


def test_gate_without_checks(spark):
    row = au.gate(spark.createDataFrame([], au.SCHEMA)).first()
    assert not row["passed"] and "no checks ran" in row["reasons"]


def test_rule_with_null_outcome(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "n int")
    rows = au.audit(df, rules=[au.Rule("positive", "n > 0")], categories=["business_rules"]).collect()
    assert [(r["column"], r["n_violations"]) for r in rows] == [("positive", 1)]


# ------------------------------------------------------------ retrieval


@pytest.mark.parametrize("cells", [4_000_000, 64])
def test_dense_search_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(rt, "QUERY_BLOCK_CELLS", cells)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8)).round(2)
    vectors[::3] = vectors[0]  # a third of all chunks are copies
    vectors[7] = 0
    asked = rng.normal(size=(20, 8)).round(2)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id bigint, vector array<float>")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query_id string, vector array<double>")
    got = {}
    for r in rt.dense_search(queries, chunks.repartition(5), 90, 0.2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    v32 = vectors.astype(np.float32).astype(float)
    norm = np.linalg.norm(v32, axis=1, keepdims=True)
    unit = np.divide(v32, norm, out=np.zeros_like(v32), where=norm > 0)
    for i, q in enumerate(asked):
        s = np.round(unit @ (q / np.linalg.norm(q)), 9)
        order = sorted(range(200), key=lambda c: (-s[c], c))[:90]
        want = [(n, c) for n, c in enumerate(order, 1) if s[c] >= 0.2]
        assert sorted(got.get(f"q{i}", [])) == want


def test_dense_search_without_queries(spark):
    chunks = spark.createDataFrame([(1, [1.0])], "chunk_id bigint, vector array<double>")
    queries = spark.createDataFrame([], "query_id bigint, vector array<double>")
    assert rt.dense_search(queries, chunks).count() == 0


def test_text_chunk_ids(spark):
    chunks = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r["chunk_id"] for r in rt.dense_search(queries, chunks, 2).orderBy("rank").collect()] == ["a", "b"]


def test_packing_stops_at_the_first_too_long(spark):
    chunks = spark.createDataFrame(
        [(1, "T", "x" * 10), (2, None, "y" * 50), (3, "U", "z")], "chunk_id int, title string, content string"
    )
    results = spark.createDataFrame(
        [(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3), (2, 2, 0.9, 1), (3, 3, 0.01, 1)],
        "query_id int, chunk_id int, score double, rank int",
    )
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    got = {r["query_id"]: r["context"] for r in rt.pack_context(results, chunks, queries, 30).collect()}
    assert got[1] == "[T]\n" + "x" * 10 + "\n"
    assert got[2] == "[Unknown]\n" + "y" * 50 + "\n"  # nothing fits: the best alone
    assert got[3] == "[U]\nz\n"  # below the floor, still the best
    assert got[4] == rt.NOTHING_FOUND
    whole = {r["query_id"]: r["context"] for r in rt.pack_context(results, chunks, None, 500).collect()}
    assert whole[1].count(rt.PART_BREAK) == 2


def test_fuse_scaled(spark):
    schema = "query_id int, url string, title string, sparse_score double, dense_score double"
    sparse = spark.createDataFrame([(1, "a", "t", 8.0, None), (1, "b", "t", 6.0, 0.5)], schema)
    dense = spark.createDataFrame([(1, "a", "t", 0.0, 0.9), (1, "c", "t", 0.0, 0.8)], schema)
    got = {r["url"]: r["hybrid_score"] for r in rt.fuse(sparse, dense).collect()}
    assert got == pytest.approx({"a": 4.8, "b": 3.8, "c": 0.32})
    scaled = {r["url"]: r["hybrid_score"] for r in rt.fuse(sparse, dense, scale=True).collect()}
    assert all(0 <= v <= 1 for v in scaled.values())


def test_thresholds(spark):
    rows = [("a", "pandas merge", True, True)] * 5 + [("b", "hello", False, False)] * 5
    df = spark.createDataFrame(rows, "g string, text string, m boolean, e boolean")
    got = {r["g"]: r["threshold"] for r in rt.adaptive_threshold(df, ["g"], ["m", "e"]).collect()}
    assert got == {"a": 3.0, "b": 6.0}


# ------------------------------------------------------------ texts


def test_truncate(spark):
    df = spark.createDataFrame([("aa\n\nbbb\n\nc",), ("short",)], "t string")
    got = [r["t"] for r in tj.truncate_paragraphs(df, "t", 5).collect()]
    assert got == ["aa\n\nbbb" + tj.TRUNCATED_MARK, "short"]


def test_extract_json(spark):
    texts = ['{"k": 1}', 'x ```json\n{"k": 2}\n``` y', 'see {"k": 3} end', "none", '{"k": ', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["json_method"], r["parsed"] and r["parsed"]["k"]) for r in tj.extract_json(df, "t", "k int").collect()]
    assert got == [("whole", 1), ("fenced", 2), ("braces", 3), (None, None), (None, None), (None, None)]


def test_extract_json_from_prose(spark):
    deep = '{"k": 5, "s": {"x": "}{"}, "a": [{"k": 6}]}'
    cases = {
        'note {x} then {"k": 1} end': ("balanced", 1),
        'he said "no { then ' + deep + " and { more": ("balanced", 5),
        'a " {b} " {"k": 4} c {bad} "': ("balanced", 4),
        "{not} {any} {of: these}": (None, None),
        'open { and {"k": 7}': ("balanced", 7),
        # the parser stops at the end of the first object
        'text {"k": 8, "t": "a \\" } b"} and } {': ("braces", 8),
        '{"k": 2} and {"k": 3}': ("whole", 2),
        "} {x} {": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: (r["json_method"], r["parsed"] and r["parsed"]["k"]) for r in tj.extract_json(df, "t", "k int").collect()}
    assert got == cases
    many = "{x} " * 2000 + '{"k": 9}'
    assert tj.extract_json(spark.createDataFrame([(many,)], "t string"), "t", "k int").first()["parsed"]["k"] == 9


def test_lines(spark):
    text = '"quoted line here"\n# comment\n// other\n- listed item\n1. numbered item\nx\n\n' + "y" * 100
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [r["line"] for r in tj.extract_lines(df, "id", "t").collect()]
    assert got == ["quoted line here", "listed item", "numbered item"]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "id int, t string")
    rows = rt.chunk_text(df, "id", "t", 1000, 200).orderBy("id", "chunk_no").collect()
    one = [r["content"] for r in rows if r["id"] == 1]
    assert one[0] + "".join(c[200:] for c in one[1:]) == text
    assert [r["content"] for r in rows if r["id"] == 2] == ["short"]


def test_quantile_brackets_stay_narrow_on_sorted_input(spark):
    df = spark.range(0, 200_000, 1, 16).selectExpr("cast(id as double) as v")
    row = st._sketches(df, ["v"], [0.5], []).first()["__sk"]
    assert row["lo_0"][0] <= 99_999.5 <= row["hi_0"][0]
    assert row["hi_0"][0] - row["lo_0"][0] < 2_000
    assert st.quantile_table(df, ["v"], [0.25, 0.5]).orderBy("prob").collect()[1]["value"] == 99_999.5


def test_long_texts_tie_by_value(spark):
    long = ["x" * 70 + c for c in "cab"] + ["x" * 64, "short"]
    df = spark.createDataFrame([(t,) for t in long for _ in range(2)], "t string")
    got = [r["value"] for r in pf.top_values(df, 3).orderBy("rank").collect()]
    assert got == sorted(long)[:3]
    tops = pf.profile(df, k=5, approx=True).first().asDict()
    assert any(v for k, v in tops.items() if "top" in k)


def test_csv_round_trip(spark, tmp_path):
    from dqengine.sources import readers, sinks

    rows = [(1, '  say "hi, you" ', "a\nb;c,d,e,f"), (2, None, "N/A"), (3, "", "x")]
    df = spark.createDataFrame(rows, "id long, t string, u string").coalesce(1)
    for sep in (",", ";", "|"):
        path = str(tmp_path / f"csv{ord(sep)}")
        sinks.write_csv(df, path, sep=sep)
        got = sorted(map(tuple, readers.read_csv(spark, path).collect()))
        assert got == [(1, '  say "hi, you" ', "a\nb;c,d,e,f"), (2, None, None), (3, None, "x")]


def test_results_are_kept_per_request(spark):
    rows = [(q, f"u{i % 60}", "t", float(100 - i), i) for q in range(10) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id int, url string, title string, hybrid_score double, rank int")
    first = rt.dedup_results(df)
    assert first.count() == 600
    assert rt.rerank(first, max_results=7).groupBy("query_id").count().filter("count = 7").count() == 10
    assert rt.dedup_results(df, by=()).count() == 60


def test_queries_beyond_one_block_give_the_same_rows(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(1, 9)) + " the" for i in range(60)]
    chunks = spark.createDataFrame([(i, t, [float(i % 7), float(i % 5), 1.0]) for i, t in enumerate(texts)], "chunk_id long, content string, vector array<float>")
    queries = spark.createDataFrame([(i, f"the w{i} w{i + 1}", [float(i % 3), 1.0, float(i % 4)]) for i in range(30)] + [(99, " ", None)], "query_id long, text string, vector array<float>")

    def rows():
        found = [rt.dense_search(queries, chunks, 5, 0.5), rt.keyword_search(queries, chunks, 5)]
        found += [rt.sparse_search(queries, chunks, m, 5, 0.1) for m in ("bm25", "tfidf")]
        return [sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in f.collect()) for f in found]

    whole = rows()
    assert all(whole) and {q for q, *_ in whole[1]} == set(range(30))
    monkeypatch.setattr(rt, "QUERY_BLOCK_CELLS", 40)
    monkeypatch.setattr(rt, "SLICE_ROWS", 7)
    monkeypatch.setattr(rt, "WORDS_SENT", 0)
    for common in (0, 12, 1000):  # every word, some, and none scored inside the task
        monkeypatch.setattr(inverted, "COMMON_CHUNKS", common)
        assert rows() == whole
    for name, value in (("CLUSTER_ROWS", 4), ("PART_ROWS", 3), ("BATCH_ROWS", 2), ("EARLY_ROWS", 6)):
        monkeypatch.setattr(clusters, name, value)
    assert rows()[0] == whole[0]


def test_chunks_are_not_copied_per_block(spark, monkeypatch):
    """A chunk's words leave it once, however many blocks the queries would have made."""
    chunks = spark.createDataFrame([(i, f"the w{i} w{i % 50}") for i in range(400)], "chunk_id long, content string")
    queries = spark.createDataFrame([(i, f"the w{i} w{i + 1}") for i in range(300)], "query_id long, text string")
    monkeypatch.setattr(rt, "QUERY_BLOCK_CELLS", 300 * 302 // 10)
    monkeypatch.setattr(inverted, "COMMON_CHUNKS", 100)
    sizes = []
    kept = inverted.materialize
    monkeypatch.setattr(inverted, "materialize", lambda df: sizes.append(0) or [out := kept(df), sizes.append(out.count())][0])
    got = rt.keyword_search(queries, chunks, 3)
    assert got.filter("rank = 1 and score > 0.6").count() == 300
    # postings, pairs that share a rare word, and what else is written
    assert max(sizes) <= 1500  # ten blocks would have copied 4,000 chunks


def test_clusters_skip_what_cannot_win(spark, monkeypatch):
    for name, value in (("CLUSTER_ROWS", 20), ("PART_ROWS", 16), ("BATCH_ROWS", 8), ("EARLY_ROWS", 40)):
        monkeypatch.setattr(clusters, name, value)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 6))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(np.repeat(middles, 50, 0) + rng.normal(size=(600, 6)) * 0.05)]
    asked = [(i, rows[i * 20][1]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    found = rt._ranked(clusters.inner_products(vectors, queries, 6, 5, 0.5), 5).collect()
    products = np.array([v for _, v in asked]) @ np.array([v for _, v in rows]).T
    want = {(q, c, r) for q in range(30) for r, c in enumerate(sorted(range(600), key=lambda c: (-round(products[q, c], 9), c))[:5], 1)}
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in found} == want
    index = clusters.build(vectors, 6)
    floors = queries.withColumn("floor", F.lit(0.9))
    seen = [r["cluster"] for late in (False, True) for r in clusters.visits(index, floors, late).collect()]
    share = sum(index.sizes[c] for c in seen) / (30 * 600)
    assert share < 0.3  # of all pairs


LINES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def near_by_hand(rows):
    """Classes of texts linked by a Jaccard similarity of 0.8 of their 5-word runs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    roots = {i: root(i) for i in sets}
    return {(i, r, sum(x == r for x in roots.values())) for i, r in roots.items()}


@pytest.mark.parametrize("hot", [1000, 6])
def test_near_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT_BAND", hot)
    rng = random.Random(9)
    base = [" ".join(rng.choice(LINES) for _ in range(60)) for _ in range(6)]
    rows = [(i, base[i % 2]) for i in range(30)]  # copies
    for i in range(30, 120):  # near copies, some close to the limit, in chains
        words = base[rng.randrange(6)].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(60)] = rng.choice(LINES)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, "  "), (202, "one two"), (203, "ONE  two"), (None, base[0]), (204, base[0]), (204, "something else entirely here"), (205, "something else entirely here")]
    df = spark.createDataFrame(rows, "id long, body string").repartition(4)
    got = [tuple(r) for r in similar.near_documents(df, "id", "body").collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(rows)
    assert similar.near_documents(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_fuzzy_finds_long_pairs(spark, limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (58, 62, 64, 65, 90, 300)]
    for t in list(texts):
        for _ in range(12):
            s = list(t)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(s))
                s[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "y"])
            texts.append("".join(s))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {tuple(r) for r in dedup.fuzzy_duplicates(df, "id", "t", limit, normalize=False).collect()}
    heads = {}
    for i, t in enumerate(texts):
        heads.setdefault(t, i)
    want = {(heads[t], i, 0) for i, t in enumerate(texts) if heads[t] != i}
    pairs = sorted(heads.items(), key=lambda x: x[1])
    want |= {(i, j, distance(a, b)) for n, (a, i) in enumerate(pairs) for b, j in pairs[n + 1 :] if abs(len(a) - len(b)) <= limit and distance(a, b) <= limit}
    assert got == want


def test_top_values_of_long_arrays(spark):
    """Two arrays that begin alike are two values, and are shown whole."""
    low, high = list(range(100)), [*range(99), -1]
    rows = [(low, "t")] * 3 + [(high, "t")] * 2 + [(None, "u" * 80)]
    for columns in (["a"], ["a", "s"]):
        df = spark.createDataFrame(rows, "a array<int>, s string").select(*columns)
        tops = [(r["value"], r["count"]) for r in pf.top_values(df).filter("column = 'a'").orderBy("rank").collect()]
        shown = ["[" + ", ".join(map(str, x)) + "]" for x in (low, high)]
        assert tops == [(shown[0], 3), (shown[1], 2), ("nan", 1)]


def test_approximate_tops_are_exact_for_frequent_values(spark):
    rows = [(f"v{i % 5}" if i % 3 else f"rare {i}", "long " * 30 + str(i % 4), float(i % 7), None if i % 10 == 0 else i) for i in range(6000)]
    df = spark.createDataFrame(rows, "s string, t string, d double, n long")
    both = [{r["name"]: (r["top_values"], r["is_nullable"]) for r in pf.profile(df, k=4, approx=a).collect()} for a in (False, True)]
    assert both[0] == both[1] and len(both[0]["s"][0]) == 4
    plan = pf.sketched_keys(df, 4, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_mixed_types_with_long_texts(spark):
    rows = [("1", "x"), ("2.5", "y"), ("z" * 100 + "b", "z"), ("z" * 100 + "a", "w"), ("z" * 100 + "a", None)]
    df = spark.createDataFrame(rows, "m string, plain string")
    got = [tuple(r) for r in pf.mixed_types(df).collect()]
    assert got == [("m", "double,int,string", "|".join(["1", "2.5", "z" * 100 + "a"]))]
    assert pf.mixed_types(df.select("plain")).count() == 0
    assert pf.mixed_types(spark.range(3)).count() == 0


def test_mixed_types_keep_cells_in_place(spark):
    """A text column's cells are not shuffled by its name, which would bring them all to one task."""
    df = spark.createDataFrame([(str(i), "x" if i % 2 else None) for i in range(50)] + [("a" * 70 + str(i), "x") for i in range(3)], "a string, b string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pf.mixed_types(df)
        assert [tuple(r) for r in got.collect()] == [("a", "int,string", "0|1|10")]
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_near_documents_write_what_may_link(spark, monkeypatch):
    """Shingles are kept for texts that share a band, and pairs for those whose sketches allow the similarity."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, twin = fresh(70), fresh(100)
    half = [shared + fresh(30) for _ in range(40)]  # about 0.5 similar, so that nearly all pairs meet in some band
    rows = [*half, *[fresh(100) for _ in range(40)], twin, [*twin, "more"]]
    seen, compared = [], similar._compared

    def kept(pairs, sets):
        seen.append((pairs.count(), sets.count()))
        return compared(pairs, sets)

    monkeypatch.setattr(similar, "_compared", kept)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "id long, body string")
    got = similar.near_documents(df, "id", "body")
    assert {tuple(r) for r in got.collect()} == {(i, min(i, 80), 2 if i >= 80 else 1) for i in range(82)}
    assert seen[0][0] == 1 and sum(n for n, _ in seen) < 5
    assert all(n <= 42 for _, n in seen)


def test_sketches_never_differ_by_more_than_the_sets(spark):
    rng = random.Random(6)
    pairs = [({rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)}, extra) for n in (0, 1, 50, 3000) for extra in (0, 1, 40, 5000)]
    rows = [(list(a), [*list(a)[extra // 2 :], *range(extra)], len(set(list(a)[: extra // 2]) ^ set(range(extra)))) for a, extra in pairs]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, differ int")
    got = df.select("differ", similar.sketches(F.col("a")).alias("a"), similar.sketches(F.col("b")).alias("b")).collect()
    for differ, a, b in got:
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
        assert len(a) == len(b) == similar.SKETCH_BITS // 64 and bits <= differ and bits % 2 == differ % 2 and (bits > 0 or not differ)


def test_near_documents_send_no_side_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(similar, "materialize", kept)
    monkeypatch.setattr(dedup, "materialize", kept)
    monkeypatch.setattr(similar, "HOT_BAND", 2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(["more", *words]), "else", None, " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 62))  # whatever may be broadcast is
    try:
        got = similar.near_documents(df, "id", "body")
        assert sorted(map(tuple, got.collect())) == [(0, 0, 4), (1, 0, 4), (2, 0, 4), (3, 3, 1), (4, 4, 1), (5, 0, 4)]
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not [p for p in plans if "BroadcastExchange" in p]
