from __future__ import annotations

import contextlib
import glob
import os

import duckdb
import pytest

from quiremill.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@contextlib.contextmanager
def other_partitions(spark):
    """Other numbers of partitions, small files, no adaptive execution."""
    new = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.execution.arrow.maxRecordsPerBatch": "17"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        # Operators that SQL can't say have tests of their own; here the rows must not hang on how they are partitioned.
        with other_partitions(spark):
            again = registry.QUERIES[name](spark, data)
            assert sorted((tuple(plain(r[c]) for c in cols) for r in again.collect()), key=repr) == got and cols
        return
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
