"""Files whose records run over lines, read by many tasks."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from dqengine.sources import readers, records


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def words(rng):
    return "".join(rng.choice(['a', 'b ', ',', ';', '"', "\n", "x\n\ny", 'say ""', "é", "{", "}"]) for _ in range(rng.randrange(1, 12))).strip() or "z"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_over_lines(spark, tmp_path, small_blocks, end):
    rng = random.Random(1)
    want = [(str(i), words(rng), words(rng)) for i in range(300)]
    want[20] = ("20", "\n" * 900 + "long", "x")  # longer than a block
    folder = tmp_path / "csv"
    folder.mkdir()
    for part in range(2):
        with open(folder / f"{part}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator=end)
            writer.writerow(["id", "a", "b"])
            writer.writerows(want[part::2])
    got = records.read_quoted_csv(spark, str(folder), ["id", "a", "b"], ",")
    assert records._pieces(spark, str(folder), "\n").select("block").distinct().count() > 5
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert readers.load_csv(spark, str(folder)).method == "sep=','"
    assert readers.read_csv(spark, str(folder)).count() == 300


def test_csv_record_of_another_width_fails(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(Exception):
        records.read_quoted_csv(spark, str(path), ["a", "b"], ",").collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_in_parts(spark, tmp_path, small_blocks, indent):
    rng = random.Random(2)
    rows = [{"id": i, "t": words(rng), "s": {"deep": [{"x": words(rng)}, {}], "q": 'br}ace \\" {'}, "n": None if i % 3 else 1.5} for i in range(200)]
    rows[7]["t"] = "}{\"" * 600  # longer than a block
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:150], indent=indent))
    (folder / "b.json").write_text(" [ ]" if indent else json.dumps(rows[150:]))
    some = rows[:150] if indent else rows
    found = records.read_json_array(spark, str(folder))
    assert found.schema == spark.read.option("multiLine", True).json(str(folder)).schema
    assert sorted(r["id"] for r in found.collect()) == [r["id"] for r in some]
    assert {(r["id"], r["t"], r["s"]["q"], r["s"]["deep"][0]["x"]) for r in found.collect()} == {(r["id"], r["t"], r["s"]["q"], r["s"]["deep"][0]["x"]) for r in some}
    parts = records.array_elements(spark, str(folder / "a.json"))
    assert parts.count() == 150
    assert readers.read_json(spark, str(folder)).count() == len(some)


@pytest.mark.parametrize("text", ["[{\"a\": 1}", "[{\"a\": 1} {\"a\": 2}]", "[{\"a\": 1}, 5]", "[{\"a\": 1}] x", "[{\"a\": {}]"])
def test_broken_json_is_an_error(spark, tmp_path, text):
    path = tmp_path / "broken.json"
    path.write_text(text)
    with pytest.raises(Exception):
        readers.read_json(spark, str(path)).select(F.max("a")).collect()


def test_one_object_stays_with_the_reader(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('{"a":\n {"b": 1}}')
    assert readers.read_json(spark, str(path)).first()["a"]["b"] == 1


def test_tasks_grow_with_the_files(spark, tmp_path, small_blocks, monkeypatch):
    """Pieces are sorted and gathered in more tasks where the files are larger, whatever the session's partitions."""
    dealt = []

    def kept(df):
        df = df.localCheckpoint()
        dealt.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(records, "materialize", kept)
    monkeypatch.setattr(records, "TASK_BYTES", 1000, raising=False)
    rows = [{"id": i, "t": "a } b\n" * 3, "s": {"x": i}} for i in range(200)]
    folder, lines = tmp_path / "json", tmp_path / "csv"
    folder.mkdir()
    lines.mkdir()
    (folder / "a.json").write_text(json.dumps(rows))
    (lines / "a.csv").write_text("id,t\n" + "".join(f'{r["id"]},"{r["t"]}"\n' for r in rows))
    tasks = -(-(folder / "a.json").stat().st_size // 1000)
    found = records.read_json_array(spark, str(folder))
    assert sorted(r["id"] for r in found.collect()) == list(range(200))
    assert tasks > 10 and min(dealt) >= tasks
    dealt.clear()
    got = records.csv_records(spark, str(lines))
    assert got.count() == 201
    assert dealt == [-(-(lines / "a.csv").stat().st_size // 1000)]
