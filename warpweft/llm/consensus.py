"""Problem 1: one consensus reading per item from annotators who disagree.

A competence-and-spamming mixture: each label of an annotator is the truth with the annotator's competence, else a draw from the annotator's own
guess distribution. Labels are the stressed nucleus of a contested word; guess distributions are kept for each number of
nuclei, so that a habit such as always stressing the first one shows. Expectation-maximisation gives both. It begins on a bounded sample of
contested items (``sample_items``, chosen by the hash of their id); then full passes over all items re-estimate every parameter until no competence changes, so that
reliabilities and consensus rest on all votes.

Defined results: null, blank and ``?`` are no reading; of an annotator's votes on an item the latest counts, of votes at one time the one with the greatest id; repeated
deliveries count once; votes on unknown items and of unnamed raters are left out; readings whose phones aren't those of the item have no vote on
stress, but count as readings; ties between positions go to the earlier one; an item without readings keeps its own string; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.plans.session import checkpointed

# Ways to type stress, phones with two spellings, nuclei of two characters, and the vowels.
STRESS = "ˈ'ˋ`´′‘’ʹʼ＇"
PHONES = {"ʦ": "ts", "ʧ": "tʃ", "ʤ": "dʒ", "ʣ": "dz", "ː": ":", "ɡ": "g", "∶": ":"}
NUCLEUS = re.compile("a:|aj|ɛj|ej|ɔj|oj|uj|oʊ|[aɛeiɪɔouʊəɐ]")
NO_READING = {"", "?"}
#: Label of a word without a stress mark.
UNSTRESSED = -1
#: Fitting ends when no competence changes by as much.
SETTLED = 1e-4


def typed(text: str) -> str:
    """The characters of a reading in one typing: stress marks ˈ, phones spelt out, no signs; blanks kept."""
    out = []
    for c in unicodedata.normalize("NFC", text):
        kind = unicodedata.category(c)
        if c in STRESS:
            out.append("ˈ")
        elif c in PHONES:
            out.append(PHONES[c])
        elif c.isspace():
            out.append(" ")
        elif c == ":" or kind[0] == "L" or c == "ˌ":
            out.append(c.lower())
    return "".join(out)


def normal_reading(text: str | None) -> str | None:
    """A reading by which two are compared; null if it is none."""
    if text is None or text.strip() in NO_READING:
        return None
    return " ".join(w for w in typed(text).split() if w.strip("ˈ")) or None


def word_label(word: str) -> tuple[str, tuple[int, ...]]:
    """Letters of a word and the places of its stress marks among them."""
    places, letters = [], []
    for c in word:
        if c == "ˈ":
            places.append(len(letters))
        else:
            letters.append(c)
    return "".join(letters), tuple(places)


def place_stress(ipa: str, labels: dict[int, tuple[int, ...]]) -> str:
    """``ipa`` with the stress of word ``j`` at ``labels[j]``; words without an entry and all other characters stay as they are."""
    out, j = [], -1
    for piece in re.split(r"(\s+)", ipa):
        length = len(typed(piece).replace("ˈ", "").strip())
        if not length or piece.isspace():
            out.append(piece)
            continue
        j += 1
        if j not in labels:
            out.append(piece)
            continue
        at, built = 0, []
        for c in piece:
            if c in STRESS:
                continue
            size = len(typed(c).strip())
            if size and at in labels[j]:
                built.append("ˈ")
            at += size
            built.append(c)
        out.append("".join(built))
    return "".join(out)


def sites(ipa: str, readings: list[str | None]) -> list[tuple[int, int, list[tuple[int, int, tuple[int, ...]]]]]:
    """Contested words of an item: word number, number of nuclei, and for each voting annotator its number, its stressed nucleus and the places."""
    base = [word_label(w)[0] for w in (normal_reading(ipa) or "").split()]
    split = [[word_label(w) for w in r.split()] if r else [] for r in readings]
    voting = [k for k, ws in enumerate(split) if [w[0] for w in ws] == base]
    found = []
    for j, letters in enumerate(base):
        places = {k: split[k][j][1] for k in voting}
        if len(set(places.values())) > 1:
            starts = [m.start() for m in NUCLEUS.finditer(letters)]
            votes = []
            for k, p in places.items():
                after = [n for n, s in enumerate(starts) if p and s >= p[0]]
                votes.append((k, UNSTRESSED if not p else after[0] if after else len(starts) - 1, p))
            found.append((j, len(starts), votes))
    return found


class Model:
    """Competence per annotator and guess distributions per annotator and number of nuclei."""

    def __init__(self, competence: dict[str, float] | None = None, guess: dict[tuple[str, int, int], float] | None = None):
        self.competence, self.guess = competence or {}, guess or {}
        self.held: dict[tuple[str, int, int], tuple[float, float]] = {}

    def weigh(self, annotator: str, n: int, label: int) -> tuple[float, float]:
        """What a vote adds to the log score of its place, and how likely it is the truth if the place is right. Worked out once per annotator and label."""
        key = annotator, n, label
        if key not in self.held:
            c, g = self.parts(*key)
            self.held[key] = log(c / ((1 - c) * g) + 1), c / (c + (1 - c) * g)
        return self.held[key]

    def parts(self, annotator: str, n: int, label: int) -> tuple[float, float]:
        """Probability of competence, and of this label as a guess."""
        return self.competence.get(annotator, 0.6), self.guess.get((annotator, n, label), 1.0 / (n + 1))

    def posterior(self, site: tuple, annotators: list[str]) -> dict[tuple[int, ...], float]:
        """How likely each of the voted places of a contested word is."""
        score: dict[tuple[int, ...], float] = defaultdict(float)
        for k, label, places in site[2]:
            score[places] += self.weigh(annotators[k], site[1], label)[0]
        top = max(score.values())
        raw = {p: exp(s - top) for p, s in score.items()}
        total = sum(raw.values())
        return {p: v / total for p, v in raw.items()}

    def expected(self, found: list[tuple], annotators: list[str], into: dict) -> None:
        """Adds for each vote how likely it was the truth and how likely a guess."""
        for site in found:
            post = self.posterior(site, annotators)
            for k, label, places in site[2]:
                true = post[places] * self.weigh(annotators[k], site[1], label)[1]
                cell = into[annotators[k], site[1], label]
                cell[0] += true
                cell[1] += 1 - true
                cell[2] += 1

    @classmethod
    def fitted(cls, cells: dict) -> Model:
        """Maximisation with one pseudo-vote spread over the labels."""
        true, count, guesses = defaultdict(float), defaultdict(float), defaultdict(float)
        for (a, n, _), (t, g, m) in cells.items():
            true[a] += t
            count[a] += m
            guesses[a, n] += g
        competence = {a: min(0.999, (true[a] + 1) / (count[a] + 2)) for a in count}
        guess = {(a, n, k): (g + 1 / (n + 1)) / (guesses[a, n] + 1) for (a, n, k), (_, g, _) in cells.items()}
        return cls(competence, guess)

    def moved(self, before: Model) -> float:
        """Greatest change of a competence; an annotator not met before had the one all begin with."""
        return max((abs(c - before.parts(a, 1, 0)[0]) for a, c in self.competence.items()), default=0.0)


def readings(items: DataFrame, votes: DataFrame) -> DataFrame:
    """``(id, ipa, annotators, readings)``: per item all annotators with a reading; at most one per annotator."""
    last_item = items.groupBy("id").agg(F.max_by(F.struct("ipa", "ipa_flash", "ipa_pro"), F.struct(F.col("exported_at"), F.coalesce("ipa_flash", F.lit("")), F.coalesce("ipa_pro", F.lit("")))).alias("x"))
    base = last_item.where("id IS NOT NULL").select("id", "x.*")
    latest = votes.where("rater IS NOT NULL AND id IS NOT NULL").groupBy("id", "rater").agg(F.max_by("ipa", F.struct("voted_at", "vote_id")).alias("reading"))
    latest = latest.select("id", F.col("rater").alias("annotator"), "reading")
    models = base.select("id", F.explode(F.array(F.struct(F.lit("flash").alias("annotator"), F.col("ipa_flash").alias("reading")), F.struct(F.lit("pro").alias("annotator"), F.col("ipa_pro").alias("reading")))).alias("v")).select("id", "v.*")
    told = latest.unionByName(models).where("trim(reading) NOT IN ('', '?')")
    per = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("annotator", "reading"))).alias("v"))
    return base.select("id", "ipa").join(per, "id", "left").select("id", "ipa", F.col("v.annotator").alias("annotators"), F.col("v.reading").alias("readings"))


def _each(batch: pd.DataFrame) -> Iterator[tuple]:
    for row in batch.itertuples(index=False):
        names = list(row.annotators) if row.annotators is not None else []
        told = [normal_reading(r) for r in (row.readings if row.readings is not None else [])]
        keep = [k for k, r in enumerate(told) if r]
        yield row.id, row.ipa, [names[k] for k in keep], [told[k] for k in keep]


def fit(per_item: DataFrame, sample_items: int = 20_000, rounds: int = 50, full_passes: int = 2, max_annotators: int = 100_000, max_passes: int = 200) -> tuple[Model, DataFrame]:
    """The fitted model, and ``(annotator, n_nuclei, label, truthful, guessed, n)`` from the last pass over all items.

    Passes over all items, ``full_passes`` at least, end when no competence changes by 1e-4 or more; if ``max_passes`` don't suffice, a warning is given. Collected are ``sample_items`` items and one row per annotator, number of nuclei and label; more than ``max_annotators`` annotators raise an error.
    """
    contested = per_item.where("size(array_distinct(readings)) > 1")
    sample = contested.orderBy(F.xxhash64("id"), "id").limit(sample_items).toPandas()
    found = [(sites(ipa or "", told), names) for _, ipa, names, told in _each(sample)]
    model = Model()
    for _ in range(rounds):
        cells: dict = defaultdict(lambda: [0.0, 0.0, 0])
        for s, names in found:
            model.expected(s, names, cells)
        before, model = model, Model.fitted(cells)
        if before.competence and model.moved(before) < SETTLED:
            break
    contested = checkpointed(contested)  # read in every pass
    for n_pass in range(1, max_passes + 1):
        sent = per_item.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            cells: dict = defaultdict(lambda: [0.0, 0.0, 0])
            for batch in batches:
                for _, ipa, names, told in _each(batch):
                    sent.value.expected(sites(ipa or "", told), names, cells)
            yield pd.DataFrame([(*k, *v) for k, v in cells.items()], columns=["annotator", "n_nuclei", "label", "truthful", "guessed", "n"])

        stats = contested.mapInPandas(count, "annotator string, n_nuclei int, label int, truthful double, guessed double, n bigint")
        stats = stats.groupBy("annotator", "n_nuclei", "label").agg(F.sum("truthful").alias("truthful"), F.sum("guessed").alias("guessed"), F.sum("n").alias("n"))
        rows = stats.limit(max_annotators * 20 + 1).collect()
        if len({r["annotator"] for r in rows}) > max_annotators or len(rows) > max_annotators * 20:
            raise ValueError(f"more than {max_annotators} annotators")
        before, model = model, Model.fitted({(r["annotator"], r["n_nuclei"], r["label"]): (r["truthful"], r["guessed"], r["n"]) for r in rows})
        change = model.moved(before)
        if n_pass >= full_passes and change < SETTLED:
            break
    else:
        warnings.warn(f"competence still changes by {change:.1g} after {max_passes} passes", stacklevel=2)
    return model, stats


CONSENSUS = "id int, ipa string, n_annotators int, n_readings int, agreement double, confidence double"


def consensus(per_item: DataFrame, model: Model) -> DataFrame:
    """Per item the consensus reading on the item's own string, the share of annotators who agree with it, and its probability under the model."""
    sent = per_item.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, ipa, names, told in _each(batch):
                text = ipa or ""
                labels, sure = {}, 1.0
                base = [word_label(w)[0] for w in (normal_reading(text) or "").split()]
                for told_words in ([word_label(w) for w in r.split()] for r in told):
                    if [w[0] for w in told_words] == base:
                        labels = {j: w[1] for j, w in enumerate(told_words)}
                        break
                for site in sites(text, told):
                    post = sent.value.posterior(site, names)
                    best = min(post, key=lambda p: (-post[p], p))
                    labels[site[0]], sure = best, sure * post[best]
                reading = place_stress(text, labels) if labels else ipa
                same = sum(r == normal_reading(reading) for r in told)
                rows.append((key, reading, len(told), len(set(told)), same / len(told) if told else None, sure if told else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONSENSUS.split(", ")])

    return per_item.mapInPandas(decide, CONSENSUS)


def reliability(stats: DataFrame) -> DataFrame:
    """Per annotator: contested words voted on, competence, and the guess that is most common when guessing."""
    per = stats.groupBy("annotator").agg(F.sum("n").alias("n_votes"), ((F.sum("truthful") + 1) / (F.sum("n") + 2)).alias("competence"))
    habit = stats.groupBy("annotator", "label").agg(F.sum("guessed").alias("g")).groupBy("annotator").agg(F.max_by("label", F.struct("g", -F.col("label"))).alias("usual_guess"), (F.max("g") / F.sum("g")).alias("usual_guess_share"))
    return per.join(habit, "annotator")
