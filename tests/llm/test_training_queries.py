"""The queries of the training-data operators that SQL can say, against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from warpweft.llm import queries as Q

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = Q.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)


def test_checks_see_what_is_wrong(spark):
    from warpweft.llm import groups, packing

    placed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, None)], "group_episode bigint, split string")
    assert tuple(groups.split_checks(placed).first()) == (4, 1, 2, 1)
    packed = spark.createDataFrame([("p", 10, 1, 0, 6, 1), ("p", 10, 2, 0, 6, 1), ("p", 10, 3, 0, 2, 2), ("p", 10, 3, 1, 2, 3)], "plan_name string, capacity int, doc_id bigint, piece int, tokens bigint, container bigint")
    assert tuple(packing.pack_checks(packed).first()) == ("p", 3, 1, 1)
