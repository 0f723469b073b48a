import random

from warpweft.llm import abuse as A

DOCS = "doc_id bigint, text string, source string, score double"
LABELS = "doc_id bigint, rater string, toxic int, labelled_at timestamp, text string"


def corpus(n, seed):
    rng = random.Random(seed)
    plain = "the teacher read a long letter near old house and wrote one new book today".split()
    docs, labels, truth = [], [], {}
    for k in range(n):
        said = [" ".join(rng.choice(plain) for _ in range(8)) + "." for _ in range(4)]
        bad = k % 5 == 0
        if bad:
            said.insert(rng.randrange(4), rng.choice(["get lost you stinking {}!", "shut your mouth you {} and go!", "only a {} like you writes this!"]).format(rng.choice(["zorn", "plork", "g r u m p"])))
        elif k % 5 == 1:
            said.insert(1, rng.choice(["the word {} stands in the dictionary.", "the farmer sold a {} at the market."]).format(rng.choice(["zorn", "plork"])))
        docs.append((k, " ".join(said), "s" if k % 2 else None, 1.0))
        truth[k] = bad
        labels.append((k, "a", int(bad if rng.random() < 0.95 else not bad), None, "x"))
        labels.append((k, "b", None if rng.random() < 0.3 else int(bad if rng.random() < 0.95 else not bad), None, "x"))
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, _ = corpus(600, 1)
    machine = A.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    new, _, truth = corpus(300, 2)
    got = {r["doc_id"]: r["n_abusive"] > 0 for r in A.score(spark.createDataFrame(new, DOCS), machine).collect()}
    assert sum(got[k] == truth[k] for k in truth) > 0.95 * len(truth)
    rates = A.rates(spark.createDataFrame(new, DOCS), A.score(spark.createDataFrame(new, DOCS), machine)).collect()
    assert sum(r["n_docs"] for r in rates) == 300


def test_disguises():
    assert A.sentence_terms("דו ביסט א ש מ א ק! w.o.r.d no​w dddone שמ*ק.") == [["דו", "ביסט", "אשמאק"], ["word", "now", "done", "שמק"]]
    assert A.bucket("1d10t") == A.bucket("idiot") and A.bucket("123") != A.bucket("ies")
    assert A.sentence_terms(None) == [] and A.sentence_terms(" . \n") == []
    assert max(map(len, A.sentence_terms("wort " * 5000))) <= A.LONG


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "s", 0.0), (2, " ", "s", 0.0), (2, "a b.", None, 0.0), (3, "wort " * 5000, "s", 0.0)], DOCS)
    none = A.fit(docs, spark.createDataFrame([], LABELS))
    assert none is None and [r["score"] for r in A.score(docs, none).collect()] == [0.0] * 4
    machine = A.fit(docs, spark.createDataFrame([(2, "a", 1, None, ""), (9, "a", 1, None, ""), (3, "a", None, None, "")], LABELS))
    rows = A.score(docs, machine).collect()
    assert len(rows) == 4 and [r["score"] for r in rows if r["doc_id"] == 1] == [0.0]
    assert A.score(docs.limit(0), machine).count() == 0
