"""Each core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from warpweft import catalogue

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if sql := catalogue.oracle_sql().get(name):
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
    else:
        assert name in WITHOUT_SQL and WITHOUT_SQL[name](df, [dict(zip(columns, r)) for r in got])


#: What must hold of queries that SQL can't say: alignments of sequences, and kernels tested against slow versions elsewhere.
WITHOUT_SQL = {
    "nw_alignment": lambda df, rows: rows and all(r["n"] > 0 and r["expected"] for r in rows),
    "word_ownership": lambda df, rows: rows and all(0 <= r["tenths"] <= 10 and r["n"] > 0 for r in rows),
    "window_choice": lambda df, rows: all(r["decision"] in ("decided", "undecided") for r in rows),
    "matching_blocks": lambda df, rows: rows and all((r["n_same"] or 0) <= r["n_words"] for r in rows),
    "reconciled_pointing": lambda df, rows: rows and {r["status"] for r in rows} <= {"ok", "repaired", "conflict", "unmarked nucleus"},
    "round_trip": lambda df, rows: sum(r["n"] for r in rows if r["agree"]) > 0,
}


def test_nearly_every_query_has_its_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set(WITHOUT_SQL)
