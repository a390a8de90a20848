"""Plans, preferences, sources, streams."""

import pytest
from pyspark.sql import functions as F

from dqengine import session
from dqengine.operators import profile as pf
from dqengine.plans import plan as pl
from dqengine.plans import prefs as pr
from dqengine.plans import suggest as sg
from dqengine.sources import readers, sinks
from dqengine.streaming.rowwise import apply_to_stream, clean_to_parquet


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("N", "01/02/2023", "R$ 1.234,56"), ("N", "01/02/2023", "R$ 1.234,56"), ("S", "x", None)]
    return spark.createDataFrame(rows, "`Regiao - Sigla` string, `Data da Coleta` string, `Valor de Venda` string")


SAMPLE_PLAN = pl.Plan(
    (
        pl.Step("standardize_column_name", "Regiao - Sigla"),
        pl.Step("convert_to_datetime", "Data da Coleta", {"format": "auto"}),
        pl.Step("convert_to_numeric", "Valor de Venda", {"decimal_separator": "comma", "remove_currency": True, "thousands": "."}),
    )
)


def test_sample_plan(sample):
    out = pl.apply_plan(sample, SAMPLE_PLAN)
    assert out.columns == ["regiao_sigla", "Data da Coleta", "Valor de Venda"]
    assert [t for _, t in out.dtypes] == ["string", "timestamp_ntz", "double"]
    assert [r[2] for r in out.collect()] == [1234.56, 1234.56, None]


def test_original_names_hold_after_renames(sample):
    plan = pl.Plan(
        (
            pl.Step("standardize_column_name", pl.ALL),
            pl.Step("rename_column", "Valor de Venda", {"new_name": "price"}),
            pl.Step("handle_nulls", "Valor de Venda", {"strategy": "fill_custom", "value": "none"}),
            pl.Step("remove_duplicates", pl.ALL, {"keep": "first"}),
        )
    )
    out = pl.apply_plan(sample, plan)
    assert out.columns == ["regiao_sigla", "data_coleta", "price"]
    assert sorted(r["price"] for r in out.collect()) == ["R$ 1.234,56", "none"]


def test_plan_errors(sample):
    with pytest.raises(ValueError, match="no column"):
        pl.apply_plan(sample, pl.Plan((pl.Step("handle_nulls", "absent"),)))
    with pytest.raises(ValueError, match="does not take"):
        pl.apply_plan(sample, pl.Plan((pl.Step("convert_case", "Regiao - Sigla", {"shape": 1}),)))
    with pytest.raises(ValueError):
        pl.Step("no_such_operation")
    with pytest.raises(ValueError):
        pl.Plan.from_json('{"transformation_steps": [], "final_output_format": "csv"}')


def test_plan_json():
    again = pl.Plan.from_json(SAMPLE_PLAN.to_json())
    assert again == SAMPLE_PLAN
    assert pl.Plan.from_json('{"transformation_steps": [{"operation_type": "filter_rows"}]}').requires_confirmation


def test_neighbouring_statistics_share_a_step():
    steps = [
        pl.Step("handle_nulls", "a", {"strategy": "fill_mean"}),
        pl.Step("handle_nulls", "b", {"strategy": "fill_median"}),
        pl.Step("normalize", "a"),
        pl.Step("normalize", "b"),
        pl.Step("filter_rows", None, {"condition": "a > 0"}),
        pl.Step("handle_nulls", "a", {"strategy": "fill_mean"}),
    ]
    assert [len(g) for g in pl._joined_fills(steps)] == [2, 2, 1, 1]


def test_every_operation_runs(spark):
    df = spark.createDataFrame([(1, "a B", 2.0), (2, "c", None)], "id int, s string, v double")
    steps = [
        ("standardize_column_name", "s", {"style": "PascalCase"}),
        ("handle_nulls", "v", {"strategy": "fill_mean"}),
        ("convert_case", "s", {"case": "title"}),
        ("change_datatype", "id", {"type": "bigint"}),
        ("filter_rows", None, {"condition": "v > 0"}),
        ("remove_duplicates", "id", {"keep": "last", "order_by": ["v"]}),
        ("derive_column", "w", {"expression": "v * 2"}),
        ("rename_column", "v", {"new_name": "value"}),
        ("convert_to_datetime", "s", {}),
        ("convert_to_numeric", "w", {}),
        ("fill_nulls", "v", {"strategy": "fill_zero"}),
        ("normalize", "v", {"method": "minmax"}),
        ("feature_engineering", "v", {"kind": "bins", "low": 0, "high": 1, "bins": 2}),
        ("data_visualization", None, {}),
        ("aggregate", None, {"by": ["id"], "what": {"v": "sum"}}),
    ]
    assert {s[0] for s in steps} == {o.value for o in pl.Operation}
    out = pl.apply_plan(df, pl.Plan(tuple(pl.Step(*s) for s in steps)))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0.0), (2, 0.0)]


def test_log_with_statistics(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (2, 4.0)], "id int, v double")
    plan = pl.Plan(
        (
            pl.Step("remove_duplicates", pl.ALL),
            pl.Step("handle_nulls", "v", {"strategy": "fill_median"}),
        )
    )
    out, log = pl.apply_logged(df, plan)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 4.0), (2, 4.0)]
    assert [(r["rows_removed"], r["cells_filled"]) for r in log().orderBy("step").collect()] == [(1, 0), (0, 1)]


def test_log_takes_one_scan_a_stage(spark):
    df = spark.createDataFrame([(1, "a ", None), (2, None, 4.0), (2, None, 4.0), (3, "B", float("nan"))], "id long, `My Text` string, v double")
    plan = pl.Plan(
        (
            pl.Step("standardize_column_name", pl.ALL),
            pl.Step("fill_nulls", "My Text", {"strategy": "fill_custom", "value": "N/A"}),
            pl.Step("convert_case", "My Text", {"case": "upper"}),
            pl.Step("derive_column", "w", {"expression": "v + 1"}),
            pl.Step("remove_duplicates", pl.ALL),
            pl.Step("handle_nulls", "v", {"strategy": "fill_mean"}),
            pl.Step("rename_column", "v", {"new_name": "value"}),
            pl.Step("handle_nulls", "w", {"strategy": "drop_rows"}),
            pl.Step("fill_nulls", "v", {"strategy": "fill_zero"}),
        )
    )
    out, log = pl.apply_logged(df, plan)
    assert sorted(map(tuple, out.collect())) == [(2, "N/A", 4.0, 5.0)] and out.columns == ["id", "my_text", "value", "w"]
    got = [(r["step"], r["rows_before"], r["rows_after"], r["cells_filled"]) for r in log().orderBy("step").collect()]
    assert got == [(1, 4, 4, 0), (2, 4, 4, 2), (3, 4, 4, 0), (4, 4, 4, -2), (5, 4, 3, 0), (6, 3, 3, 2), (7, 3, 3, 0), (8, 3, 1, 2), (9, 1, 1, 0)]
    # three stages and the mean that stands in two of them, for nine steps
    scans = log()._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + log()._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    assert scans <= 6
    assert pl.apply_logged(df, pl.Plan(()))[1]().count() == 0


# ------------------------------------------------------------ suggestions


def steps_of(df, **caps):
    return [(r["operation_type"], r["column_name"]) for r in sg.suggest_steps(pf.profile(df), **caps).orderBy("step").collect()]


def test_suggestions(sample):
    got = steps_of(sample)
    assert got[:3] == [("standardize_column_name", c) for c in sample.columns]
    assert ("handle_nulls", "Valor de Venda") in got and ("convert_to_datetime", "Data da Coleta") in got
    assert ("convert_to_numeric", "Valor de Venda") in got and got[-1] == ("remove_duplicates", "all_columns")


def test_suggestion_caps(spark):
    wide = spark.range(1).select(*[F.lit("x").alias(f"date {i}") for i in range(14)])
    got = steps_of(wide, caps=sg.SHORT_PLAN, most=sg.SHORT_STEPS)
    assert len(got) == 12
    assert [o for o, _ in got].count("standardize_column_name") == 10
    # without caps every column gets its steps, and duplicate removal is never cut off
    whole = steps_of(wide)
    assert [o for o, _ in whole].count("standardize_column_name") == [o for o, _ in whole].count("convert_to_datetime") == 14
    assert whole[-1] == ("remove_duplicates", "all_columns")


def test_generic_suggestion(spark):
    assert steps_of(spark.range(3).toDF("id")) == [
        ("standardize_column_name", "all_columns"),
        ("handle_nulls", "id"),
    ]


# ------------------------------------------------------------ preferences


def test_preferences_round_trip(tmp_path):
    prefs = pr.Preferences(numeric_missing_strategy=pr.MissingStrategy.FILL_MEAN, decimal_places=2)
    path = str(tmp_path / "config" / "prefs.json")
    prefs.save(path)
    assert pr.Preferences.load(path) == prefs
    assert pr.Preferences.load(str(tmp_path / "none.json")) is None
    with pytest.raises(ValueError):
        pr.Preferences.from_json("{}")


@pytest.mark.parametrize("strategy", list(pr.MissingStrategy))
def test_each_missing_strategy(spark, strategy):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, v double")
    prefs = pr.Preferences(numeric_missing_strategy=strategy, handle_outliers=False)
    out = sg.clean_with_preferences(df, prefs, order_by=["id"], fill_value=9)
    got = {r["id"]: r["v"] for r in out.collect()}
    want = {
        "drop_rows": "absent", "fill_zero": 0.0, "fill_mean": 2.0, "fill_median": 2.0, "fill_mode": 1.0,
        "fill_forward": 1.0, "fill_backward": 3.0, "fill_custom": 9.0, "keep_as_null": None,
    }[strategy.value]
    assert got.get(2, "absent") == want


# ------------------------------------------------------------ sources


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_strategies(spark, tmp_path):
    comma = readers.load_csv(spark, write(tmp_path, "a.csv", "id,v,s\n1,2.5,x\n2,NULL,N/A\n"))
    assert comma.method == "default" and comma.df.dtypes == [("id", "bigint"), ("v", "double"), ("s", "string")]
    assert [tuple(r) for r in comma.df.collect()] == [(1, 2.5, "x"), (2, None, None)]
    semicolon = readers.load_csv(spark, write(tmp_path, "b.csv", "id;v\n1;2,5\n"))
    assert semicolon.method == "auto-detect" and semicolon.df.columns == ["id", "v"]
    pipe = readers.load_csv(spark, write(tmp_path, "c.csv", "id|v\n1|x\n"))
    assert pipe.df.columns == ["id", "v"]


def test_ragged_csv_fails_with_its_path(spark, tmp_path):
    path = write(tmp_path, "r.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(ValueError, match="r.csv"):
        readers.load_csv(spark, path)


def test_json_array_and_dispatch(spark, tmp_path):
    path = write(tmp_path, "a.json", '[{"id": 1, "s": "x"}, {"id": 2, "s": null}]')
    assert readers.read_source(spark, path, "json").count() == 2
    with pytest.raises(ValueError, match="not supported"):
        readers.read_source(spark, path, "excel")
    with pytest.raises(ValueError, match="no path"):
        readers.read_source(spark, "")
    with pytest.raises(ValueError):
        readers.read_json(spark, str(tmp_path / "absent.json"))


def test_corpus_is_built_once(spark, tmp_path):
    path, built = str(tmp_path / "corpus"), []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "x", [0.5])], "chunk_id int, content string, vector array<double>")

    assert readers.load_corpus(spark, path, build).count() == 1
    assert readers.load_corpus(spark, path, build).count() == 1
    assert built == [1]


def test_damaged_corpus_is_built_again(spark, tmp_path):
    path, built = tmp_path / "corpus", []

    def build():
        built.append(1)
        return spark.range(1000).selectExpr("id as chunk_id", "repeat(id, 9) as content", "array(id / 7.0D) as vector").repartition(3)

    readers.load_corpus(spark, str(path), build)
    part = sorted(path.glob("data/*/part-*.parquet"))[0]
    whole = part.read_bytes()
    for damaged in (whole[: len(whole) // 2], None):
        # cut short, and gone with its checksum file
        if damaged is None:
            sorted(path.glob("data/*/part-*.parquet"))[0].unlink()
        else:
            part.write_bytes(damaged)
        for crc in path.glob("data/*/.*.crc"):
            crc.unlink()
        assert readers.load_corpus(spark, str(path), build).count() == 1000
    assert 2 <= len(built) <= 3

    def fails():
        raise OSError("no more")

    # a rebuild that breaks off leaves what there was
    with pytest.raises(Exception):
        sinks.save_corpus(spark.range(10).selectExpr("id", "raise_error('stop') as x"), str(path))
    assert readers.load_corpus(spark, str(path), fails).count() == 1000


def test_parquet_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    sinks.write_parquet(df, str(tmp_path / "deep" / "t"), partition_by=["k"])
    plan = spark.read.parquet(str(tmp_path / "deep" / "t")).filter("k = 'a'")
    assert [r["id"] for r in plan.collect()] == [1]


# ------------------------------------------------------------ session and streams


def test_size_checked_broadcast(spark):
    small = spark.range(5)
    plan = lambda: big.join(session.size_checked(small), "id")._jdf.queryExecution().executedPlan().toString()
    big = spark.range(100)
    assert "BroadcastHashJoin" in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")  # fewer bytes than the file has
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_beyond_the_bound_is_whole(spark, monkeypatch):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    want = {("a", 1, 10), (None, 2, 20), ("b", 3, None)}
    assert {tuple(r) for r in session.join_stats(left, right, ["k"]).collect()} == want
    monkeypatch.setattr(session, "size_checked", lambda df: df)
    assert {tuple(r) for r in session.join_stats(left, right, ["k"]).collect()} == want


def test_stream(spark, tmp_path, sample):
    source = str(tmp_path / "in")
    sample.toDF("region", "day", "price").write.parquet(source)
    plan = pl.Plan(
        (
            pl.Step("convert_to_datetime", "day"),
            pl.Step("convert_to_numeric", "price", {"decimal_separator": "comma", "remove_currency": True, "thousands": "."}),
            pl.Step("fill_nulls", "price", {"strategy": "fill_zero"}),
            pl.Step("rename_column", "price", {"new_name": "amount"}),
            pl.Step("filter_rows", None, {"condition": "amount >= 0"}),
        )
    )
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = clean_to_parquet(stream, plan, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    got = sorted(r["amount"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0.0, 1234.56, 1234.56]
    with pytest.raises(ValueError, match="whole table"):
        apply_to_stream(stream, pl.Plan((pl.Step("remove_duplicates", pl.ALL),)))
