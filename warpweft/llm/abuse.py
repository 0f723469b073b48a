"""Problem 8: documents with a sentence that abuses, incites hate or is sexually explicit.

A factorization machine over hashed terms scores each sentence: besides the weight of each term it has a vector per term, whose products weigh
every pair of terms of the sentence, such as an insult next to "you" or a people next to a verb of harm. It is fitted on a bounded sample of labelled documents
(``sample_docs``, chosen by the hash of their id). Labels are of documents, so sentences get theirs in rounds: at first all
sentences of a document carry its label; each round, a machine fitted on other documents decides which of them keep it.

Defined results: null and blank texts score 0; of a rater's labels of a document the latest counts, null is no label; ties among raters count as half; documents
without labels take no part in fitting; without any positive label every score is 0; repeated rows are scored one by one; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import BareTable, to_latin

BUCKETS = 1 << 18
#: Sentences of more than LONG words are read in windows of WINDOW words, each half over the next, so that none is diluted.
LONG, WINDOW = 16, 12
FOLDS = 3
#: Share of the sentences of clean documents that a suspect sentence must outscore to be learnt as abusive.
CLEAN_SHARE = 0.99
#: Probability at which a later round keeps a sentence.
KEEP = 0.5
# Digits and signs written for letters.
DIGIT_LETTERS = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile(r"[.!?…。]+(?=\s|$)|[\r\n]+")
_SPACED = re.compile(r"(^|[\s.*_·\-])(\w[ .*_·\-]+\w[ .*_·\-]+\w(?!\w)(?:[ .*_·\-]+\w(?!\w))*)")
_SPACED_SIGNS = re.compile(r"[ .*_·\-]+")
_REPEATED = re.compile(r"(\w)\1{2,}")


class _KeepSigns(BareTable):
    """Like ``BareTable``, but keeps the signs that part sentences and those that disguise words."""

    def __missing__(self, code: int) -> str | None:
        sign = self.alike.get(chr(code), chr(code))
        if sign in ".!?\n\r*_-" or chr(code) in "…。·":
            self[code] = sign
            return sign
        return super().__missing__(code)


_SIGNS = _KeepSigns()
_OTHER_SIGNS = re.compile(r"[.!?_\-…。·]")


def sentence_terms(text: str | None) -> list[list[str]]:
    """The words of each sentence, by look, with disguises undone: letters set apart are joined, repeated letters and signs within words dropped."""
    if not text:
        return []
    plain = to_latin(text).translate(_SIGNS)
    plain = _REPEATED.sub(r"\1", _SPACED.sub(lambda m: m[1] + _SPACED_SIGNS.sub("", m[2]), plain))
    found = []
    for s in _SENTENCE.split(plain):
        words = _OTHER_SIGNS.sub(" ", s.replace("*", "")).split()
        if len(words) <= LONG:
            if words:
                found.append(words)
        else:
            found += [words[k : k + WINDOW] for k in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
    return found


def bucket(word: str) -> int:
    """The term of a word; digits among Latin letters count as the letters they stand for."""
    if not word.isalpha() and not word.isdigit() and re.search("[a-z]", word):
        word = word.translate(DIGIT_LETTERS)
    return zlib.crc32(word.encode()) % BUCKETS


class Machine:
    """Parameters of a factorization machine of degree two."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def scores(self, terms: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability for each sentence; ``terms`` holds their buckets one after another, no sentence is empty."""
        if not len(starts):
            return np.empty(0, np.float32)
        scale = (1 / np.sqrt(sizes)).astype(np.float32)
        v = self.vectors[terms]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat((v * v).sum(1), starts)
        linear = np.add.reduceat(self.weights[terms], starts)
        z = self.bias + linear * scale + 0.5 * ((sums * sums).sum(1) - squares) * scale * scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fitted(cls, sentences: list[np.ndarray], target: np.ndarray, weight: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.3, decay: float = 3e-4, least: int = 3) -> Machine:
        """Adagrad on the weighted log loss; terms in fewer than ``least`` sentences have no part."""
        rng = np.random.default_rng(7)
        counts = np.bincount(np.concatenate(sentences) if sentences else np.empty(0, int), minlength=BUCKETS)
        kept = counts >= least
        w = np.zeros(BUCKETS, np.float32)
        v = np.where(kept[:, None], rng.normal(0, 0.05, (BUCKETS, factors)), 0).astype(np.float32)
        gw, gv, gb, b = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, factors), 1e-6, np.float32), 1e-6, -2.0
        used = [s[kept[s]] for s in sentences]
        order = np.array([k for k, s in enumerate(used) if len(s)], dtype=np.int64)
        for _ in range(epochs):
            rng.shuffle(order)
            for part in np.array_split(order, max(1, len(order) // 512)):
                if not len(part):
                    continue
                terms = np.concatenate([used[k] for k in part])
                sizes = np.array([len(used[k]) for k in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                scale = (1 / np.sqrt(sizes)).astype(np.float32)
                vt = v[terms]
                sums = np.add.reduceat(vt, starts, axis=0)
                z = b + np.add.reduceat(w[terms], starts) * scale + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vt * vt).sum(1), starts)) * scale * scale
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part]).astype(np.float32)
                own = np.repeat(np.arange(len(part)), sizes)
                dw = g[own] * scale[own]
                dv = (g * scale * scale)[own][:, None] * (sums[own] - vt)
                unique, inverse = np.unique(terms, return_inverse=True)
                sw = np.bincount(inverse, dw, len(unique)) / len(part) + decay * w[unique]
                sv = np.stack([np.bincount(inverse, dv[:, f], len(unique)) for f in range(factors)], 1) / len(part) + decay * v[unique]
                gw[unique] += sw**2
                gv[unique] += sv**2
                w[unique] -= rate * sw / np.sqrt(gw[unique])
                v[unique] -= rate * sv / np.sqrt(gv[unique])
                gb += float(g.mean()) ** 2
                b -= rate * float(g.mean()) / np.sqrt(gb)
        return cls(b, w, v)

    def of(self, sentences: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sentences])
        return self.scores(np.concatenate(sentences), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if sentences else np.empty(0)


def document_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)``: mean of the raters' latest labels."""
    latest = labels.where("doc_id IS NOT NULL AND rater IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id", "rater").agg(F.max_by("toxic", F.struct("labelled_at", "toxic")).alias("toxic"))
    return latest.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"), F.count("*").alias("n_raters"))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, rounds: int = 3) -> Machine | None:
    """A machine from at most ``sample_docs`` labelled documents; null if none of them is labelled as abusive."""
    chosen = document_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    return fit_rows([tuple(r) for r in rows], rounds)


def fit_rows(rows: list[tuple[int, str, float]], rounds: int = 3) -> Machine | None:
    """A machine from documents with their text and the mean of their labels."""
    # One instance per sentence, part of the documents and label, weighted by its documents: a sentence that recurs is evidence each time.
    seen: dict[tuple, int] = defaultdict(int)
    for doc, text, toxic in rows:
        for words in {tuple(w) for w in sentence_terms(text)}:
            seen[words, zlib.crc32(str(doc).encode()) % FOLDS, toxic >= 0.5] += 1
    keys = sorted(seen)
    suspect = np.array([k[2] for k in keys], dtype=bool)
    if not suspect.any():
        return None
    number = {words: n for n, words in enumerate(dict.fromkeys(k[0] for k in keys))}
    terms = [np.unique([bucket(w) for w in words]) for words in number]
    sentences = [terms[number[k[0]]] for k in keys]
    fold = np.array([k[1] for k in keys])
    times = np.array([seen[k] for k in keys], dtype=float)
    clean_total, suspect_total = times[~suspect].sum(), times[suspect].sum()
    target = suspect.astype(float)
    weight = times * np.where(suspect, max(1.0, clean_total / suspect_total), 1.0)
    for turn in range(rounds):
        given = np.zeros(len(keys))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test) and len(train):
                given[test] = Machine.fitted([sentences[k] for k in train], target[train], weight[train], epochs=8).of([sentences[k] for k in test])
        # Kept are suspect sentences that machines fitted on other documents score above nearly all sentences of clean documents. The few
        # abusive sentences that raters let pass stay among the clean ones: they are outweighed by their likes.
        usual = float(np.quantile(given[~suspect], CLEAN_SHARE)) if (~suspect).any() else 0.5
        abusive = suspect & (given > (max(usual, KEEP) if turn else usual))
        target = abusive.astype(float)
        weight = times * np.where(abusive, max(1.0, min(10.0, 0.2 * times.sum() / max(1.0, times[abusive].sum()))), np.where(suspect & (given > usual / 2), 0.3, 1.0))
    return Machine.fitted(sentences, target, weight)


SCORES = "doc_id bigint, score double, n_sentences int, n_abusive int, sentence int"


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.5) -> DataFrame:
    """Per document the highest sentence score, the number of sentences at ``threshold`` or above, and which sentence is the highest."""
    if machine is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("n_sentences"), F.lit(0).alias("n_abusive"), F.lit(None).cast("int").alias("sentence"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            sizes, terms, per_doc = [], [], []
            for text in batch["text"]:
                each = sentence_terms(text)
                per_doc.append(len(each))
                for words in each:
                    own = set()
                    for w in words:
                        b = known.get(w)
                        if b is None:
                            if len(known) > 300_000:
                                known.clear()
                            b = known[w] = bucket(w)
                        own.add(b)
                    sizes.append(len(own))
                    terms.extend(own)
            counts = np.array(sizes, dtype=np.int64)
            p = sent.value.scores(np.array(terms, dtype=np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts, counts)
            out, at = [], 0
            for key, m in zip(batch["doc_id"], per_doc):
                own = p[at : at + m]
                at += m
                out.append((key, float(own.max()) if m else 0.0, m, int((own >= threshold).sum()), int(own.argmax()) if m else None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])
            frame["sentence"] = frame["sentence"].astype("Int32")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(judge, SCORES)


def rates(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per source: documents, abusive documents, and their share. Rows of one id, which all have been scored, meet one score."""
    best = scores.groupBy("doc_id").agg(F.max("n_abusive").alias("n_abusive"))
    named = docs.select("doc_id", "source").join(best, "doc_id")
    return named.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_abusive") > 0).alias("n_abusive"), F.avg((F.col("n_abusive") > 0).cast("int")).alias("rate"))
