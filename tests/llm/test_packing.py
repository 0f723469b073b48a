from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from warpweft.llm import packing as P
from warpweft.llm import queries as Q


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_closest_fill_is_optimal(counts, room):
    chosen = P.closest_fill(sorted(counts, reverse=True), counts, room)
    best = max(t for c in product(*[range(counts[n] + 1) for n in counts]) if (t := sum(a * n for a, n in zip(c, counts))) <= room)
    assert sum(n * m for n, m in chosen.items()) == best and all(m <= counts[n] for n, m in chosen.items())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_block_places_each_piece_once(lengths):
    placed = P.pack_block([(k, 0, n) for k, n in enumerate(lengths)], 50)
    assert sorted((d, n) for d, _, n, *_ in placed) == sorted(enumerate(lengths))
    room = {}
    for _, _, n, container, position, start in placed:
        assert room.get(container, 0) == start
        room[container] = start + n
    assert all(v <= 50 for v in room.values())


def test_pack(spark):
    rows = [(1, 0), (2, 10), (3, 25), (4, 20), (5, 7), (5, 7), (None, 3), (6, 10)]
    placed = P.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), [("p", 10), ("none", None), ("zero", 0)], block_pieces=4).collect()
    assert {r["plan_name"] for r in placed} == {"p"} and sum(r["tokens"] for r in placed) == 82
    assert [r["container"] for r in placed if r["doc_id"] == 1] == [None]
    assert sorted(r["tokens"] for r in placed if r["doc_id"] == 3) == [5, 10, 10] and len([r for r in placed if r["doc_id"] == 5]) == 2
    assert P.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [("p", 10)]).count() == 0


def test_repeated_and_null_ids_fill_no_block_by_themselves(spark):
    big = (1 << 60) + 1
    rows = [(7, 3)] * 400 + [(None, 3)] * 400 + [(big, 3), (big + 1, 25), (big + 2, 25)]
    placed = P.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), [("p", 10)], block_pieces=50)
    got = placed.collect()
    assert sum(r["tokens"] for r in got) == sum(n for _, n in rows) and {r["doc_id"] for r in got} == {7, None, big, big + 1, big + 2}
    blocks = {}
    for r in got:
        if r["container"] < 1 << 62:
            blocks[r["container"] >> 32] = blocks.get(r["container"] >> 32, 0) + 1
    assert max(blocks.values()) < 150
    assert all(u["used"] <= 10 for u in placed.groupBy("container").agg(F.sum("tokens").alias("used")).collect())
    assert P.fill_report(placed).first()["fullest"] == 10


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (4, "wort " * 5000, 5)], "doc_id bigint, text string, tokens bigint")
    got = {r["doc_id"]: r["tokens"] for r in P.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 5000


@pytest.mark.parametrize("query, table, columns", [(Q.p6_pack, "pack_plan", "plan_name string, capacity int"), (Q.p3_splits, "split_plan", "split_name string, share double")])
def test_plans_beyond_the_bound_are_an_error(spark, tmp_path, query, table, columns):
    kind = int if "int" in columns else float
    for n in (1000, 1001):
        spark.createDataFrame([(f"p{k}", kind(k + 1)) for k in range(n)], columns).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        if n == 1000:
            assert len(Q._plan(spark, tmp_path, table, columns.split()[0])) == n
    with pytest.raises(ValueError, match=f"{table} has more than 1000 rows"):
        query(spark, str(tmp_path))
