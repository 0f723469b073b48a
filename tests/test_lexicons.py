from warpweft.operators.routing import route
from warpweft.sources import lexicons as L
from warpweft.sources.tables import write_lexicon


def test_absent_lexicons_are_empty_and_present_ones_typed(spark, tmp_path):
    assert all(L.lexicon(spark, str(tmp_path), kind).count() == 0 for kind in L.SCHEMAS)
    books = spark.createDataFrame([("a'b", "ab", ["x"], "p", "r", "w", 2, 0.9, "extra")], L.SCHEMAS["books"] + ", more string")
    write_lexicon(books, str(tmp_path / "books.parquet"), "key", ["key"])
    gold = spark.createDataFrame([("c", "kɔ", [], "G", 3, None)], L.SCHEMAS["gold"])
    write_lexicon(gold, str(tmp_path / "gold.parquet"), "key", ["key"])
    assert [f"{n} {t}" for n, t in L.lexicon(spark, str(tmp_path), "books").dtypes] == L.SCHEMAS["books"].split(", ")
    types = spark.createDataFrame([("a'b",), ("c",), ("d",)], "w string").selectExpr("w", "w AS key")
    got = {r["w"]: (r["tier"], r["confidence"]) for r in route(types, "w", "key", L.tiers(spark, str(tmp_path))).collect()}
    assert got == {"a'b": ("books", "LOW"), "c": ("gold", "HIGH"), "d": (None, "LOW")}
