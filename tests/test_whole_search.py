"""The whole search queries against their SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["search_index_terms_whole", "search_hits_whole", "search_hits_messages"])
def test_whole_search(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got = Counter(map(tuple, __spark_entry__.queries()[name](spark, TABLES).collect()))
    assert got and got == Counter(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    if name == "search_hits_whole":
        assert {int(d.split("doc")[-1]) % 3 for (d,) in got if d.startswith("artifact/")} == {0, 1, 2}
    if name == "search_hits_messages":
        assert all(d.startswith("message/") for (d,) in got)
