"""The registered queries that SQL can express, against their SQL."""

import duckdb
import pytest

from plumbline.llm.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, compare


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    state, _, note = compare(spark, con, name, folder, QUERIES, ORACLES)
    assert state == "ok", note
