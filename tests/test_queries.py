"""Every registered query against its SQL, on the smallest tables, and the driver's contract."""

import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry
from dqengine import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = spark_rows(registry.QUERIES[name](spark, FOLDER))
    assert len(set(got[0])) == len(got[0])
    assert difference(got, duck_rows(con, registry.ORACLES[name])) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_every_survey_row_is_covered():
    families = dict(S=7, P=12, N=5, C=10, H=13, M=11, D=7, X=14, U=7, A=4, K=25, R=18, T=7, L=4)
    wanted = {f"{f}{i}" for f, n in families.items() for i in range(1, n + 1)}
    assert {c for text in registry.COVERS.values() for c in text.split()} == wanted
