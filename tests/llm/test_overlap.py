import random

import numpy as np
import pytest

from warpweft.llm import overlap as O


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "val", "s", 1, "clash") for r in rows], "side string, id string, text string, split string, source string, uid bigint, canon string")
    members, links = O.linked_texts(df)
    return {(r["id_a"], r["id_b"]) for r in O.overlap_pairs(members, links).collect()}, O.overlap_report(members, links).collect()


def test_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = []
    for k in range(90):
        n = rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 90])
        texts.append([rng.choice(words[: 8 if rng.random() < 0.3 else 60]) for _ in range(n)])
    for t in texts[:60]:
        for share in (0.1, 0.25, 0.33, 0.36):
            new = list(t)
            for _ in range(max(0, round(share * len(t)))):
                kind, at = rng.randrange(3), rng.randrange(len(new) or 1)
                if kind == 0 and new:
                    new[at] = rng.choice(words)
                elif kind == 1 and len(new) > 1:
                    del new[at]
                else:
                    new.insert(at, rng.choice(words))
            texts.append(new)
    rows = [("train" if rng.random() < 0.6 else "eval", f"r{k:03d}", " ".join(t)) for k, t in enumerate(texts)]
    want = set()
    for s, i, a in rows:
        for s2, j, b in rows:
            x, y = a.split(), b.split()
            if s == "train" and s2 == "eval" and 3 * edits(x, y) < max(len(x), len(y)):
                want.add((min(i, j), max(i, j)))
    got, report = run(spark, rows)
    assert got == want and sum(r["n_pairs"] for r in report) == len(want)


def test_look_and_edge_cases(spark):
    rows = [("train", "a", "Guten, Tag! ֿ"), ("eval", "b", "guten tag"), ("eval", "c", None), ("train", "d", None), ("eval", "e", " .,"), ("train", "f", "!"), ("train", "g", "guten tag"), ("eval", "h", "wort " * 3000), ("train", "i", "wort " * 2999 + "ander")]
    got, _ = run(spark, rows)
    assert got == {("a", "b"), ("b", "g"), ("h", "i")}
    assert run(spark, [])[0] == set()


@pytest.mark.parametrize("n", [50, 78, 79, 118, 300, 301, 450, 600, 900, 6000])
def test_key_count_is_bounded_for_long_texts(n):
    words = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    assert len(O.rare_keys(words, np.ones(O.BUCKETS, np.int64))) < 10_000


def test_long_texts_near_their_bounds(spark):
    rng = random.Random(5)
    rows = []
    for n in (75, 85, 290, 310, 600):
        text = [f"w{rng.randrange(4000):04d}x" for _ in range(n)]
        text = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in text]
        rows.append(("train", f"t{n}", " ".join(text)))
        for share in (0.30, 0.36):
            new = list(text)
            for at in rng.sample(range(n), int(share * n)):
                new[at] = "fremd" + chr(97 + at % 26)
            rows.append(("eval", f"e{n}-{share}", " ".join(new)))
    got, _ = run(spark, rows)
    assert got == {(f"e{n}-0.3", f"t{n}") for n in (75, 85, 290, 310, 600)}


def test_nothing_of_unknown_size_is_sent_whole(spark):
    df = spark.createDataFrame([("train", "a", "eins zwei drei vier"), ("eval", "b", "eins zwei drei vier")], "side string, id string, text string")
    plan = O.overlap_pairs(*O.linked_texts(df))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_keys_take_little_more_room_than_words():
    for n in (13, 20, 30, 60, 78):
        words = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        assert len(O.rare_keys(words, np.ones(O.BUCKETS, np.int64))) < 2 * n


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_rounds_lose_no_pair_and_leave_no_shuffle_files(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[f"w{chr(97 + rng.randrange(26))}" for _ in range(rng.choice([4, 7, 9, 14, 20, 31]))] for _ in range(60)]
    rows = [("train", f"t{k:02d}", " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        new = list(t)
        for _ in range(-(-len(t) // 3) - 1):
            new.insert(rng.randrange(len(new) + 1), "neu") if rng.random() < 0.3 else new.pop(rng.randrange(len(new)))
        rows.append(("eval", f"e{k:02d}", " ".join(new)))
    want = {(i, j) for s, i, a in rows for s2, j, b in rows if s == "eval" and s2 == "train" and 3 * edits(a.split(), b.split()) < max(len(a.split()), len(b.split()))}
    df = spark.createDataFrame(rows, "side string, id string, text string")
    monkeypatch.setattr(O, "WORDS_A_ROUND", 100, raising=False)
    before = shuffle_files(spark)
    members, links = O.linked_texts(df)
    left = {x.split("_")[1] for x in shuffle_files(spark) - before}
    assert {(r["id_a"], r["id_b"]) for r in O.overlap_pairs(members, links).collect()} == want and len(want) >= 20
    # The counts of words alone may be left: one shuffle of bounded size.
    assert len(left) <= 1


def test_every_near_pair_has_a_key_in_common_and_signatures_that_allow_it():
    rng = random.Random(8)
    counts = np.array([rng.randrange(1, 9) for _ in range(O.BUCKETS)], np.int64)
    for _ in range(4000):
        n = rng.randrange(3, 32)
        a = [rng.randrange(1, 12) * 7919 for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(1, -(-n // 3) + 2)):
            at = rng.choice([0, len(b), rng.randrange(len(b) + 1)])
            b[at : at + rng.randrange(2)] = [rng.randrange(1, 12) * 7919] * rng.randrange(2)
        longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
        most = -(-len(longer) // 3) - 1
        if len(shorter) < 3 or a == b or edits(a, b) > most:
            continue
        x, y = (np.array(t, np.uint64) for t in (longer, shorter))
        zero = np.array([0])
        assert set(O.segment_keys(x, zero, np.array([len(x)]), counts)[1]) & set(O.window_keys(y, zero, np.array([len(y)]))[1])
        p, q = (O.signatures(t, zero, counts) for t in (x, y))
        assert sum(int(v[0] & ~w[0]).bit_count() for v, w in zip(p, q)) <= most
        assert sum(int(w[0] & ~v[0]).bit_count() for v, w in zip(p, q)) <= most - (len(x) - len(y))
