import random

from warpweft.llm import passages as P


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def brute(doc, item):
    reach = len(item) + 10
    return item and any(2 * common(doc[k : k + reach], item) >= len(item) for k in range(max(1, len(doc))))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 25, 40])))) for k in range(20)]
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 5, 60, 300]))]
        if k % 3:
            part = rng.choice(items)[1].split()
            part = part[: max(1, round(rng.choice([0.4, 0.5, 0.6, 1]) * len(part)))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[: len(part) // 2] + [rng.choice(words)] * rng.choice([0, 2, 8]) + part[len(part) // 2 :]
        docs.append((k, " ".join(text)))
    want = {(d, i) for d, t in docs for i, x in items if brute(t.split(), x.split())}
    hits = P.find_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_words=150)
    got = {(r["doc_id"], r["item_id"]) for r in hits.collect()}
    assert got == want


def test_breaks_and_edge_cases(spark):
    item = "eins zwei drei vier fünf sechs sieben acht neun zehn"
    docs = [(1, "x Eins, zwei drei vi-\ner [00:12] fünf\n- 12 -\nsechs sieben acht y"), (2, None), (3, ""), (4, item), (4, item), (5, "wort " * 6000 + item), (6, "eins zwei drei vier")]
    docs = spark.createDataFrame([(*d, "clash", 3) for d in docs], "doc_id bigint, text string, item_id string, matched int")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, " ", 1)], "item_id bigint, text string, doc_id bigint")
    hits = P.find_passages(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in hits.collect()) == [(1, 7), (4, 7), (4, 7), (5, 7)]
    assert [r["matched"] for r in hits.where("doc_id = 1").collect()] == [8]
    assert sorted(r["doc_id"] for r in P.without_leaks(docs, hits).collect()) == [2, 3, 6]
    assert P.find_passages(docs.limit(0), items).count() == 0 and P.find_passages(docs, items.limit(0)).count() == 0


def test_scattered_words(spark):
    """Every other word of an item stands in the document, a foreign or changed word between, so no two neighbours meet."""
    item = [f"w{k}" for k in range(60)]
    broken = [w if k % 2 else f"x{k}" for k, w in enumerate(item)]
    rng = random.Random(5)
    few = [rng.choice("abcdefg") for _ in range(70)]
    items = [(1, " ".join(item)), (2, " ".join(few)), (3, " ".join(few[:20]))]
    docs = [(1, "y z " + " ".join(broken) + " y z"), (2, " ".join(broken[:58])), (3, " ".join(reversed(item)))]
    docs += [(k, " ".join(rng.choice(letters) for letters in [rng.choice(["abcdefgh", "abcdefghijklmno"])] for _ in range(rng.choice([30, 70, 200])))) for k in range(4, 60)]
    want = {(d, i) for d, t in docs for i, x in items if brute(t.split(), x.split())}
    hits = P.find_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == want
    assert (1, 1) in want and (2, 1) not in want and {i for _, i in want} == {1, 2, 3} and len(want) < 150
    assert [(r["matched"], r["first_word"]) for r in hits if (r["doc_id"], r["item_id"]) == (1, 1)] == [(30, 3)]


def test_items_of_few_different_pairs(spark):
    """A refrain of 40 words with 5 different pairs of neighbours, whole and in part, and an item that repeats itself less."""
    refrain = "la li lo lu le".split() * 8
    half = [f"w{k}" for k in range(20)] + ["tra", "la"] * 10
    items = [(1, " ".join(refrain)), (2, " ".join(half)), (3, "ho " * 30)]
    docs = [(1, "a b " + " ".join(refrain) + " c"), (2, " ".join(refrain[:20])), (3, " ".join(refrain[:19])), (4, "tra la " * 10), (5, "ho " * 15), (6, "ho " * 14)]
    want = {(d, i) for d, t in docs for i, x in items if brute(t.split(), x.split())}
    assert want == {(1, 1), (2, 1), (4, 2), (5, 3)}
    hits = P.find_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == want


def test_blocks_of_words(spark):
    """Blocks are cut by words: 20 items of 20 words make more than one of 150 words, and one of 1000."""
    items = [(k, " ".join(f"w{k}-{n}" for n in range(10))) for k in range(20)]
    docs = spark.createDataFrame([(k, "x " + t) for k, t in items], "doc_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    several, single = P.find_passages(docs, held, block_words=150), P.find_passages(docs, held, block_words=1000)
    passes = [h._jdf.queryExecution().analyzed().toString().count("MapInArrow") for h in (several, single)]
    assert passes[0] >= 3 and passes[1] == 1
    assert sorted(several.collect()) == sorted(single.collect()) and {(k, k) for k in range(20)} <= {(r["doc_id"], r["item_id"]) for r in several.collect()}
