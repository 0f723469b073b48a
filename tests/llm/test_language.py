from warpweft.llm import language as L

ROWS = "asr_id bigint, text_whisper string, language string, lang string, label string"
YI, HE, EN, DE, RU, YL = "דער לערער האט געשריבן א בוך.", "הוא כתב את הספר של האיש.", "the teacher wrote a long book today.", "der Lehrer schrieb ein Buch und die Frau las.", "он написал эту книгу вчера.", "der lerer hot geshribn a bikh un er iz do."


def run(spark, rows):
    seed = [(1000 + k, t, lang) for k in range(6) for t, lang in ((YI, "yi"), (HE, "he"), (EN, "en"), (DE, "de"), (RU, "ru"), (YL, "yi"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + seed], ROWS)
    p = L.prepared(df)
    runs = L.segments(p, L.fit(df))
    return runs, p


def test_languages(spark):
    rows = [(1, YI, None), (2, f"{YI} {EN}", "YI"), (3, YL, "de"), (4, HE, "iw"), (5, RU, "Russian"), (6, DE, "en-US"), (7, None, "yi"), (8, "♪♪", ""), (9, "", None), (10, (YI + " ") * 500, "ji"), (11, "דער לערער האט geschrieben א בוך.", "yi")]
    runs, p = run(spark, rows)
    found = {(r["asr_id"], r["lang"]) for r in L.mislabelled(runs).collect() if r["asr_id"] < 1000}
    assert found == {(1, "yi"), (2, "en"), (3, "yi"), (6, "de")}
    per = {r["asr_id"]: r for r in L.transcript_language(p, runs).collect()}
    assert per[2]["n_languages"] == 2 and per[7]["lang"] is None and per[9]["n_languages"] == 0 and 0.5 < per[10]["confidence"] <= 1


def test_labels(spark):
    names = ["yi-IL", "JI", "Yiddish", "iw", "heb", "EN", "German", "und", "unknown", "", None, "fr"]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "l string").select(L.label_language(F.col("l"))).collect()]
    assert got == ["yi", "yi", "yi", "he", "he", "en", "de", None, None, None, None, "fr"]


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert L.segments(L.prepared(df), L.fit(df)).count() == 0


def test_unseen_words_back_off_to_ngrams():
    model = L.Backoff.fitted([("en", ["walking", "talking", "singing"]), ("de", ["geschrieben", "gegangen", "gesungen"])])
    assert model.best(["jogging"])[0] == "en" and model.best(["gesprungen"])[0] == "de" and model.best(["123"]) is None
