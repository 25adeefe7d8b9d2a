"""Every registered query of the raster engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridmill.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def second():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in row)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, second, name):
    got = QUERIES[name](spark, DATA)
    rows = [plain(r) for r in got.select(*sorted(got.columns)).collect()]
    if name not in ORACLES:
        assert rows
        return
    want = second.sql(ORACLES[name])
    wanted = second.sql(f"select {', '.join(chr(34) + c + chr(34) for c in sorted(want.columns))} from want").fetchall()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(rows, key=repr) == sorted(map(plain, wanted), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["image_id", "label"]
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
