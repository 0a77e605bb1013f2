"""Every core query against its SQL at the smallest scale, where the tables are at hand."""

import glob
import os

import duckdb
import pytest

from studflow.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in catalogue.oracle_sql():
        assert len(df.columns) == len(set(df.columns))
        return
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    quoted = ", ".join(f'"{x}"' for x in cols)
    want = c.execute(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    key = lambda r: str([round(v, 6) if isinstance(v, float) else v for v in r])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
