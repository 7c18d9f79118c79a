"""Every query with an oracle gives the rows of its DuckDB SQL."""

import os
import sys

import duckdb
import pytest

from freshet.plans import check_queries, geometry_queries, map_queries, model_queries, series_queries, stored_queries, storm_queries  # noqa: F401
from freshet.plans.registry import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v + 0.0, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), bad[:3])
    types = {type(v) for r in got for v in r} ^ {type(v) for r in want for v in r}
    assert not types - {type(None)}, types
    assert got, sys.intern(name)
