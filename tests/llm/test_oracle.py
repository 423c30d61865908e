"""Operators with oracle SQL equal DuckDB on the sf0.001 tables; the line limit of the quality rules on sf0.1 too, where it binds."""

import duckdb
import pytest

from retentio.llm.oracle import ORACLE
from retentio.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import canon

SF_LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, folder", [*((name, SF_SMALL) for name in sorted(ORACLE)), ("op6_quality_rules", SF_LARGE)])
def test_matches_duckdb(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    sdf = QUERIES[name](spark, folder)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(cols)
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(cols, res.fetchall())
