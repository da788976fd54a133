"""Every registered query against its SQL on the smallest tables."""

import inspect
import os

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameReader

import __spark_entry__ as entry
from vellum.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() == 100


# queries that fill a store or a landing folder, or number rows they have written, before their result is read
WRITERS = ("scratch_path", "_filled", "_landed", "walk(")
LAZY = [n for n, f in registry.QUERIES.items() if not any(w in inspect.getsource(f) for w in WRITERS)]


def test_building_a_query_runs_no_job(spark, monkeypatch):
    """Schemas are known here, so that reading a footer does not count."""
    schemas = {f.split(".")[0]: spark.read.parquet(f"{DATA}/{f}").schema for f in os.listdir(DATA)}
    read = DataFrameReader.parquet

    def known(self, path):
        return read(self.schema(schemas[os.path.basename(path).split(".")[0]]), path)

    monkeypatch.setattr(DataFrameReader, "parquet", known)
    sc = spark.sparkContext
    assert len(LAZY) > 70
    for name in LAZY:
        sc.setJobGroup(f"build-{name}", name)
        registry.QUERIES[name](spark, DATA)
        assert not sc.statusTracker().getJobIdsForGroup(f"build-{name}"), name
    sc.setLocalProperty("spark.jobGroup.id", None)
