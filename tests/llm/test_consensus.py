import random

from warpweft.llm import consensus as C

ITEMS = "id int, sentence_yi string, ipa string, ipa_flash string, ipa_pro string, exported_at timestamp, label string"
VOTES = "vote_id bigint, id int, rater string, ipa string, voted_at timestamp, n bigint"


def frames(spark, items, votes):
    i = [(k, "x", ipa, flash, pro, None, "clash") for k, ipa, flash, pro in items]
    v = [(n, k, r, ipa, None, 7) for n, (k, r, ipa) in enumerate(votes)]
    per = C.readings(spark.createDataFrame(i, ITEMS), spark.createDataFrame(v, VOTES))
    model, stats = C.fit(per)
    return {r["id"]: r for r in C.consensus(per, model).collect()}, {r["annotator"]: r for r in C.reliability(stats).collect()}


def test_typing_forms_are_one_reading():
    assert C.normal_reading(" /za:n 'altɛr tsimˈɛr./ ") == C.normal_reading("zaːn ˈaltɛr ʦimˋɛr")
    assert C.normal_reading("?") is None and C.normal_reading("  ") is None and C.normal_reading(None) is None
    assert C.place_stress("zaːn ˈaltɛr, ʦimɛr!", {1: (3,), 2: (4,)}) == "zaːn altˈɛr, ʦimˈɛr!"
    assert C.place_stress("ʦimˈɛr", {0: ()}) == "ʦimɛr"


def test_skill_outweighs_numbers(spark):
    rng = random.Random(3)
    forms = ["alˈtɛr", "ˈaltɛr"]
    items, votes, truth = [], [], {}
    for k in range(120):
        t = rng.randrange(2)
        truth[k] = f"dɔs {forms[t]} briv"
        say = lambda good, t=t: f"dɔs {forms[t if rng.random() < good else 1 - t]} briv"
        items.append((k, f"dɔs {forms[1 - t]} briv", say(0.85), say(0.85)))
        votes += [(k, f"spam{n}", f"dɔs {forms[1]} briv") for n in range(3)] + [(k, "good", say(0.97)), (k, "weak1", say(0.6)), (k, "weak2", say(0.6))]
    found, who = frames(spark, items, votes)
    contested = [k for k in found if found[k]["n_readings"] > 1]
    assert sum(found[k]["ipa"] == truth[k] for k in contested) > 0.85 * len(contested)
    assert who["good"]["competence"] > 0.7 > 0.4 > who["spam1"]["competence"]


def test_edge_cases(spark):
    items = [(1, "a bˈa", None, None), (2, "mˈama", "mamˈa", "mˈama"), (3, None, "x", "?"), (4, "tˈata", "", "tatˈa")]
    votes = [(2, "r", "mˈama"), (2, "r", "mˈama"), (2, "s", None), (9, "r", "bˈa"), (1, None, "bˈa"), (4, "r", "tatˈa " * 400)]
    found, _ = frames(spark, items, votes)
    assert found[1]["ipa"] == "a bˈa" and found[1]["n_annotators"] == 0 and found[1]["agreement"] is None
    assert found[2]["ipa"] == "mˈama" and found[2]["n_annotators"] == 3
    assert found[3]["ipa"] is None or found[3]["ipa"] == ""
    assert found[4]["ipa"] == "tatˈa" and found[4]["n_readings"] == 2
    assert set(found) == {1, 2, 3, 4}


def test_empty_tables(spark):
    found, who = frames(spark, [], [])
    assert found == {} and who == {}


def test_small_sample_converges_to_the_same(spark):
    """Beyond the sample, passes over all items go on until competences stand still, also for an annotator the sample lacks."""
    rng = random.Random(4)
    forms = ["alˈtɛr", "ˈaltɛr"]
    items, votes = [], []
    for k in range(300):
        t = rng.randrange(2)
        say = lambda good, t=t: f"dɔs {forms[t if rng.random() < good else 1 - t]} briv"
        items.append((k, "x", f"dɔs {forms[t]} briv", say(0.8), say(0.7), None, "clash"))
        votes += [(k, "good", say(0.97)), (k, "weak", say(0.6))] + ([(k, "seldom", say(0.95))] if k % 8 == 5 else [])
    votes = [(n, k, r, ipa, None, 7) for n, (k, r, ipa) in enumerate(votes)]
    per = C.readings(spark.createDataFrame(items, ITEMS), spark.createDataFrame(votes, VOTES)).cache()
    sampled = per.where("size(array_distinct(readings)) > 1").orderBy(C.F.xxhash64("id"), "id").limit(4).collect()
    assert not any("seldom" in r["annotators"] for r in sampled)
    whole, few = C.fit(per)[0].competence, C.fit(per, sample_items=4)[0].competence
    assert set(whole) == set(few) == {"flash", "pro", "good", "weak", "seldom"}
    assert all(abs(whole[a] - few[a]) < 0.002 for a in whole)
