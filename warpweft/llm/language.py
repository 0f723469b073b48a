"""Problem 5: the language of each transcript and of each segment of a mixed one, whatever its label says.

Word-first backoff: a known word scores its log frequency in each language; an unknown one the mean score of its longest known character n-grams,
from ``LONGEST`` down to one. A language in two alphabets is two classes; only classes of a sentence's alphabet compete.
The model is fitted on a bounded sample of transcripts (``sample_rows``, chosen by the hash of their id): it begins with the labels as given and a few
function words, labels the sample's sentences anew and is fitted again, so wrong labels lose their weight.

Defined results: null, blank and wordless texts have no segment and language null; sentences without a letter belong to the segment before; ties go to the class listed first;
repeated rows are judged one by one; unknown labels count as the name of another language; further columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import plain_form

# The classes by alphabet, and the language of each.
CLASSES = {"hebrew": ["yi", "he"], "latin": ["yi_latn", "en", "de"], "cyrillic": ["ru"]}
LANGUAGE = {"yi": "yi", "he": "he", "yi_latn": "yi", "en": "en", "de": "de", "ru": "ru"}
# Frequent function words by class.
FUNCTION_WORDS = {
    "yi": "און דער די דאס איז האט איך ער זי מיר נישט פון אין אויף מיט צו וואס אבער זיי דו איר א אן דעם",
    "he": "של את על אני הוא היא הם לא כל זה עם אם כי או אל גם אבל אחד אנחנו אתה היה מה",
    "yi_latn": "un der di dos iz hot ikh er zi mir nisht fun in oyf mit tsu vos ober zey du ir a an dem vet",
    "en": "the and of to a in is that it he she we you they was for with this but not or on said one every",
    "de": "der die das und ist ich er sie wir nicht von in auf mit zu aber ein eine dieser im den wenn man ihr",
    "ru": "и в не на я он она мы вы что это с но как по этот мой все они вчера",
}
# Names of the five languages in ISO codes, present and withdrawn, and in English.
NAMES = {"yi": "yi ji yid ydd yih yiddish", "he": "he iw heb hebrew", "en": "en eng english", "de": "de deu ger german", "ru": "ru rus russian"}
NO_LABEL = ["", "und", "unknown"]
LONGEST = 6
SENTENCE_END = r"(?<=[.!?…。．！？])[\p{Cf}\"'”’)]*\s+|[\r\n]+"


def label_language(label: Column) -> Column:
    """The language a label names: one of the five, the label itself for any other, null if there is none."""
    name = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_]*)", 1)
    named = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        named = F.when(name.isin(names.split()), lang).otherwise(named)
    return F.when(label.isNull() | F.lower(F.trim(label)).isin(NO_LABEL), F.lit(None)).otherwise(F.coalesce(named, name))


def sentences(text: Column) -> Column:
    """Sentences as written, without blank ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s) != "")


def alphabet(words: list[str]) -> str | None:
    """Alphabet of most letters."""
    count: Counter = Counter()
    for w in words:
        for c in w:
            if "א" <= c <= "ת":
                count["hebrew"] += 1
            elif "a" <= c <= "z" or c == "ß":
                count["latin"] += 1
            elif "а" <= c <= "ё":
                count["cyrillic"] += 1
    return count.most_common(1)[0][0] if count else None


def letters_only(words: str) -> list[str]:
    return [w for w in words.split() if not w.isdigit()]


class Backoff:
    """Log frequencies of words and of character n-grams in each class."""

    def __init__(self) -> None:
        self.words: dict[str, Counter] = {c: Counter() for cs in CLASSES.values() for c in cs}
        self.grams: list[dict[str, Counter]] = [{c: Counter() for c in self.words} for _ in range(LONGEST + 1)]
        self.seen: dict[tuple[str, str], dict[str, float]] = {}

    @classmethod
    def fitted(cls, labelled: list[tuple[str, list[str]]]) -> Backoff:
        model = cls()
        for c, text in FUNCTION_WORDS.items():
            model.words[c].update({w: 3 for w in text.split()})
        for c, words in labelled:
            model.words[c].update(words)
        for c, counts in model.words.items():
            for w, n in counts.items():
                padded = f"<{w}>"
                for size in range(1, LONGEST + 1):
                    for k in range(len(padded) - size + 1):
                        model.grams[size][c][padded[k : k + size]] += n
        model.totals = {c: sum(x.values()) + 1 for c, x in model.words.items()}
        model.gram_totals = [{c: sum(x.values()) + 1 for c, x in g.items()} for g in model.grams]
        return model

    def word(self, w: str, script: str) -> dict[str, float]:
        """Score of a word in each class of an alphabet."""
        if (found := self.seen.get((w, script))) is not None:
            return found
        classes = CLASSES[script]
        if any(self.words[c][w] > 1 for c in classes):
            scores = {c: log((self.words[c][w] + 0.05) / self.totals[c]) for c in classes}
        else:
            scores = dict.fromkeys(classes, 0.0)
            padded = f"<{w}>"
            for size in range(LONGEST, 0, -1):
                known = [g for k in range(len(padded) - size + 1) if any(self.grams[size][c][g := padded[k : k + size]] for c in classes)]
                if known:
                    scores = {c: sum(log((self.grams[size][c][g] + 0.05) / self.gram_totals[size][c]) for g in known) / len(known) for c in classes}
                    break
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[w, script] = scores
        return scores

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """Class of a sentence and its probability among the classes of its alphabet; null without a letter."""
        script = alphabet(words)
        if script is None:
            return None
        own = [w for w in words if alphabet([w]) == script]
        total = dict.fromkeys(CLASSES[script], 0.0)
        for w in own:
            for c, s in self.word(w, script).items():
                total[c] += s
        top = max(total, key=lambda c: total[c])
        # Words of one sentence are not independent: their evidence is tempered.
        return top, 1 / sum(exp(max(-50.0, 0.5 * (s - total[top]))) for s in total.values())


def prepared(transcripts: DataFrame) -> DataFrame:
    """``(asr_id, label, said, words)``: the language named by the label, the sentences, and their words."""
    s = transcripts.select("asr_id", label_language(F.col("language")).alias("label"), sentences(F.col("text_whisper")).alias("said"))
    return s.withColumn("words", F.transform("said", plain_form))


def fit(transcripts: DataFrame, sample_rows: int = 20_000, rounds: int = 4) -> Backoff:
    """A model from at most ``sample_rows`` transcripts with a text, chosen by the hash of their id before any text is cut into words."""
    chosen = transcripts.where("trim(text_whisper) <> ''").select("asr_id", "language", "text_whisper").orderBy(F.xxhash64("asr_id"), "asr_id").limit(sample_rows)
    sample = prepared(chosen).where("size(said) > 0").select("asr_id", "label", "words").collect()
    texts = [(r["label"], [letters_only(w) for w in r["words"]]) for r in sample]
    labelled = []
    for label, each in texts:
        for words in each:
            script = alphabet(words)
            own = [c for c in CLASSES.get(script, []) if LANGUAGE[c] == label]
            if own:
                labelled.append((own[0], words))
    model = Backoff.fitted(labelled)
    for _ in range(rounds):
        labelled = [(b[0], words) for _, each in texts for words in each if (b := model.best(words))]
        model = Backoff.fitted(labelled)
    return model


SEGMENTS = "asr_id bigint, segment int, lang string, confidence double, n_sentences int, n_words int, text string, label string"


def segments(rows: DataFrame, model: Backoff, least_words: int = 2) -> DataFrame:
    """Runs of sentences in one language, in order, with a confidence each.

    A sentence of fewer than ``least_words`` words can't change the language by itself: it joins the run before it, or else the one after it.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, named, said, words in batch[["asr_id", "label", "said", "words"]].itertuples(index=False):
                runs: list[list] = []
                waiting: list[str] = []
                for text, ws in zip(said, words):
                    tokens = letters_only(ws)
                    b = sent.value.best(tokens)
                    if b is None or len(tokens) < least_words and runs:
                        if runs:
                            runs[-1][3].append(text)
                        else:
                            waiting.append(text)
                        continue
                    lang, sure = LANGUAGE[b[0]], b[1]
                    if runs and runs[-1][0] == lang:
                        runs[-1][1] += sure * len(tokens)
                        runs[-1][2] += len(tokens)
                        runs[-1][3].append(text)
                        runs[-1][4] += 1
                    else:
                        runs.append([lang, sure * len(tokens), len(tokens), [*waiting, text], 1])
                        waiting = []
                if len(runs) > 1 and runs[0][2] < least_words:
                    if runs[1][0] != runs[0][0]:
                        runs[1][3][:0] = runs.pop(0)[3]
                out += [(key, k, r[0], r[1] / r[2], r[4], r[2], " ".join(r[3]), named) for k, r in enumerate(runs)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return rows.select("asr_id", "label", "said", "words").mapInPandas(label, SEGMENTS)


def transcript_language(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``(asr_id, label, lang, confidence, n_languages)``: the language with most words of each transcript; its confidence is its segments' times its share of words."""
    per = runs.groupBy("asr_id", "lang").agg(F.sum("n_words").alias("w"), F.sum(F.col("confidence") * F.col("n_words")).alias("s"))
    top = per.groupBy("asr_id").agg(F.max_by(F.struct("lang", "s"), F.struct(F.col("w"), F.col("lang"))).alias("x"), F.sum("w").alias("all"), F.count("*").alias("n_languages"))
    return rows.select("asr_id", "label").join(top, "asr_id", "left").select("asr_id", "label", F.col("x.lang").alias("lang"), (F.col("x.s") / F.col("all")).alias("confidence"), F.coalesce("n_languages", F.lit(0)).alias("n_languages"))


def mislabelled(runs: DataFrame) -> DataFrame:
    """``(asr_id, lang)`` for each language of a transcript that its label doesn't name."""
    return runs.where("label IS NULL OR label <> lang").select("asr_id", "lang").distinct()
