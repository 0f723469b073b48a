from pyspark.sql import functions as F  # noqa: F401

from warpweft.operators import pointing as N

A, O, E, DOT = "ַ", "ָ", "ֶ", "ּ"
RULE = N.Convention(
    points={A: "a", O: "o", E: "e"}, lettered={("ו", DOT): "u", ("א", A): "a", ("א", O): "o"}, carriers="אוי", allowed={"a": frozenset({"a", "aː"}), "o": frozenset({"o"}), "e": frozenset({"e", "ə"}), "u": frozenset({"u"})},
    nuclei=("aː", "aj", "a", "o", "e", "ə", "u"), silent=frozenset({"ə"}), tail=frozenset({"aj"}), dropped={"o": "ə"},
)


def test_slots():
    vowels = lambda w: [v for v, _ in N.slots(N.units_of(w), RULE)]
    assert vowels(f"ב{A}אג{O}") == ["a", "o"] and vowels(f"א{A}ו{A}ב") == ["a"] and vowels(f"ב{A}א{A}") == ["a"] and vowels(f"ב{A}ג{A}") == ["a", "a"]
    assert vowels(f"ו{DOT}ב") == ["u"] and vowels(f"ב{DOT}") == [] and vowels("") == []


def test_reconcile_each_status():
    assert N.reconcile(f"ב{A}ג", "baːg", RULE) == (f"ב{A}ג", "ok")
    assert N.reconcile(f"בג{A}", "bəga", RULE)[1] == "ok"
    assert N.reconcile(f"ב{A}ג", "bag", RULE)[1] == "ok" and N.reconcile(f"ב{A}ג", "bagaj", RULE)[1] == "ok"
    assert N.reconcile(f"ב{A}ג", "bog", RULE) == (None, "conflict") and N.reconcile(f"ב{A}ג", "bg", RULE) == (None, "conflict")
    assert N.reconcile(f"ב{A}ג", "bago", RULE) == (None, "unmarked nucleus") and N.reconcile("בג", "bg", RULE) == ("בג", "ok")
    assert N.reconcile(f"ב{O}ג", "bəg", RULE) == ("בג", "repaired")


def test_reattach():
    assert N.reattach(f"וו{A}אב", RULE, "א") == f"ווא{A}ב"
    assert N.reattach(f"ו{E}וב", RULE, "א") == f"וו{E}ב" and N.reattach(f"ו{E}ו{E}ב", RULE, "א") == f"וו{E}ב"
    assert N.reattach(f"א{A}ו{O}ב", RULE, "א") == f"א{A}ו{O}ב" and N.reattach("", RULE, "א") == ""


def test_nearest_pointing_takes_fewest_changes():
    read = lambda w: "".join({A: "a", O: "o"}.get(c, {"ב": "b", "ג": "g"}.get(c, "")) for c in w)
    assert N.nearest_pointing(f"ב{A}ג", "bag", read, [A, O]) == f"ב{A}ג"
    assert N.nearest_pointing(f"ב{A}ג", "bog", read, [A, O]) == f"ב{O}ג"
    assert N.nearest_pointing(f"ב{A}ג", "bgo", read, [A, O]) == f"בג{O}"
    assert N.nearest_pointing("בבבב", "babababa", read, [A, O]) is None


def test_over_rows(spark):
    df = spark.createDataFrame([(f"ב{A}ג", "bag", 1), (f"ב{A}ג", "bag", 2), (f"ב{A}ג", None, 3), (f"ב{A}ג", "bog", 4)], "p string, i string, k int")
    got = {r["k"]: r["status"] for r in N.reconciled(df, "p", "i", RULE).collect()}
    assert got == {1: "ok", 2: "ok", 3: None, 4: "conflict"}
