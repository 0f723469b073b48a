import random

from warpweft.llm import groups as G

from pyspark.sql import functions as F

META = "episode string, speaker string, guest string, reupload_of string, u string, v string"


def brute(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(a, a + 1) for a in range(100, 160)] + [(500, b) for b in range(501, 900)]  # a long chain and a hot node
    links += [tuple(sorted((rng.randrange(1000, 1400), rng.randrange(1000, 1400)))) for _ in range(220)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == brute(links)


def test_names(spark):
    names = ["1000001", "ep_1000001", "#1000001", "001000001", "1000001_03", "1000001.0", "audio/1000001.mp3", "gold/1000001.jsonl.bak", "‎1000001", "１０００００１", " 1000001 ", "", None, "abc", "12345678"]
    df = spark.createDataFrame([(n,) for n in names], "episode string")
    assert [r[0] for r in df.select(G.episode_id(F.col("episode"))).collect()] == [1000001] * 11 + [None] * 4
    people = ["spk_0000007", "SPK-0000007 ", "spk-0000007", "unknown", "n/a", "?", "", None]
    nodes = [r[0] for r in spark.createDataFrame([(p,) for p in people], "p string").select(G.person_node(F.col("p"))).collect()]
    assert len(set(nodes[:3])) == 1 and nodes[0] > 10**9 and nodes[3:] == [None] * 5


def test_groups_and_splits(spark):
    meta = [("1000003", "spk_0000001", None, None), ("1000002", "spk_0000001", "spk_0000002", None), ("1000001", "SPK-0000002", "unknown", None), ("1000005", "unknown", None, "ep_1000009"), ("1000009", None, None, None), ("1000009", None, None, None)]
    meta = spark.createDataFrame([(*m, "x", "y") for m in meta], META)
    names = ["ep_1000003", "1000002", "1000005", "7000000", None, ""] + [f"20000{k:02d}" for k in range(60)]
    rows = spark.createDataFrame([(k, n, "old", 3) for k, n in enumerate(names)], "key int, episode string, split string, bucket int")
    named = G.named_groups(rows, meta)
    got = {r["episode"]: r["group_episode"] for r in named.collect()}
    assert got["ep_1000003"] == got["1000002"] == 1000001 and got["1000005"] == 1000005 and got["7000000"] == 7000000 and len(got) == 64
    placed = G.assign_splits(rows, "key", named, [("train", 0.8), ("val", 0.1), ("test", 0.1)]).collect()
    assert len(placed) == len(names) and {r["bucket"] for r in placed} == {3} and {r["split"] for r in placed} == {"train", "val", "test"}
    where = {}
    for r in placed:
        if r["group_episode"]:
            assert where.setdefault(r["group_episode"], r["split"]) == r["split"]


def test_empty(spark):
    meta, rows = spark.createDataFrame([], META), spark.createDataFrame([], "key int, episode string")
    named = G.named_groups(rows, meta)
    assert named.count() == 0 and G.assign_splits(rows, "key", named, [("train", 1.0)]).count() == 0
