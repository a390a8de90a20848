"""Every stage on what the one before kept, and the whole run."""

import corpus_pipeline
import pytest
from samples import EDGES, table
from test_search import python_components, python_hits, python_print, python_tokens

from dqengine.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_crf", "simhash", "decontaminate", "mixing", "token_files"]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = stages["quality_crf"](spark, docs, FOLDER)
    kept = {r["doc_id"] for r in good.collect()}
    assert all((i in kept) == (q == 1) for i, q in quality.items()) and good.columns == docs.columns

    rows = rows_of(good)
    one = stages["simhash"](spark, good, FOLDER)
    assert {i for i, _ in rows_of(one)} == set(python_components([python_print(t) for _, t in rows], [i for i, _ in rows]))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, one, FOLDER)
    assert {i for i, _ in rows_of(clean)} == {r[0] for r in python_hits(rows_of(one), items) if not r[2]}

    taken = {r["doc_id"]: r["__copies"] for r in mixing.mix(clean).collect()}
    mixed = stages["mixing"](spark, clean, FOLDER)
    assert rows_of(mixed) == sorted((r for r in rows_of(clean) for _ in range(taken[r[0]])), key=repr)
    files = stages["token_files"](spark, mixed, FOLDER).orderBy("start").collect()
    assert [tuple(r) for r in files] == python_tokens(sorted(rows_of(mixed)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, files))


@pytest.mark.parametrize("rows", [EDGES, []])
def test_stages_stand_edges(spark, rows):
    docs = table(spark, rows, clash=False)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "token_files":
            assert out.columns == docs.columns
            # stages are tried on the edge rows themselves: the classifier may well reject them
            docs = docs if name == "quality_crf" else out
        out.count()
