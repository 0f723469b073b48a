"""Problem 4: records of evaluation splits that also stand, exactly or almost, in the training split.

Records are canonicalised (look, case, points, punctuation, blanks) and hashed; the hashes of the evaluation side are joined with those of the
training side. This finds equal records. Records that differ in some words need more: of two texts whose word edit distance is below a third of the longer one, the
longer is cut into one segment more than there may be edits, so that one segment stands unchanged in the shorter; segments and runs of
words are the keys of a second hash join, whose pairs are verified by the edit distance. No pair within the bound is lost.

Keys take many times the room of the texts, so they are joined in rounds, each of one share of all keys, whose shuffle files go before the next begins.

Defined results: null and blank texts, and texts without a word, have no partner; repeated rows are joined once by their canonical text and expanded at the
end; texts of fewer than three words have only exact partners; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import with_bare_form
from warpweft.plans.session import forgotten, written

#: Buckets of the word counts by which rarity is judged: the size of what is collected and sent.
BUCKETS = 1 << 16
#: Bits of a text's signature, and how many of them one common word has for itself; all other words share the rest.
BITS, OWN_BITS = 128, 96
#: Rounds in which the keys are joined: one for so many words, but no more than so many, as each reads all texts.
WORDS_A_ROUND, MOST_ROUNDS = 2_000_000, 4
#: Words whose keys are made at once.
WORDS_AT_ONCE = 1_000_000
#: Marks of keys: anywhere in a text, at its beginning, at its end.
ANYWHERE, BEGINNING, END = 0, 1, 2
#: Keys of texts as the longer one of a pair on the evaluation side, and on the training side, are told apart by this.
TRAIN_LONGER = np.uint64(0xD6E8FEB86659FD93)


def _run_keys(flat: np.ndarray, at: np.ndarray, width: int, mark: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place ``at`` on."""
    h = np.full(len(at), np.uint64(4 * width + mark))
    for k in range(width):
        h = (h ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts with ``n`` things each: the text of every thing, and its number in it."""
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def segment_keys(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, key)``: each text as the longer one of a pair, cut into ceil(n/3) segments, one more than edits are allowed.

    Segments have three words; a remainder of one makes the first and the last have two, a remainder of two that of both whose two words are rarer. The first stands at
    the beginning and the last at the end of the partner too, if words put in before and after them count as theirs: with fewer edits than segments, one segment has none.
    """
    k = np.where(n > 3, -(-n // 3), 0)
    seen = counts[flat % np.uint64(BUCKETS)].astype(float)
    last = begin + n - 1
    early = (n % 3 == 1) | ((n % 3 == 2) & (seen[begin] * seen[begin + 1] < seen[last - 1] * seen[last]))
    late = (n % 3 == 1) | ((n % 3 == 2) & ~early)
    text, i = _places(k)
    at = begin[text] + 3 * i - (early[text] & (i > 0))
    mark = np.where(i == 0, BEGINNING, np.where(i == k[text] - 1, END, ANYWHERE))
    two = ((mark == BEGINNING) & early[text]) | ((mark == END) & late[text])
    keys = np.empty(len(at), np.uint64)
    for width, m in ((3, ANYWHERE), (3, BEGINNING), (3, END), (2, BEGINNING), (2, END)):
        chosen = (mark == m) & (two == (width == 2))
        keys[chosen] = _run_keys(flat, at[chosen], width, m)
    return text, keys


def window_keys(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, key)``: each text, of three words at least, as the shorter one of a pair: whatever may be an unchanged segment of the longer one."""
    text, i = _places(n - 2)
    all_texts, end = np.arange(len(n)), begin + n
    keys = [_run_keys(flat, begin[text] + i, 3, ANYWHERE)]
    for width in (2, 3):
        keys += [_run_keys(flat, begin, width, BEGINNING), _run_keys(flat, end - width, width, END)]
    return np.concatenate([text, *[all_texts] * 4]), np.concatenate(keys)


def rare_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All keys of one text on the evaluation side."""
    begin, n = np.array([0]), np.array([len(words)])
    return np.concatenate([segment_keys(words, begin, n, counts)[1], window_keys(words, begin, n)[1] ^ TRAIN_LONGER])


def signatures(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Which words each text has, as bits in two numbers: the commonest have a bit each, others share one with others."""
    bit = OWN_BITS + np.arange(BUCKETS) % (BITS - OWN_BITS)
    bit[np.argsort(-counts, kind="stable")[:OWN_BITS]] = np.arange(OWN_BITS)
    of = bit[(flat % np.uint64(BUCKETS)).astype(np.int64)]
    one = np.uint64(1) << (of % 64).astype(np.uint64)
    return [np.bitwise_or.reduceat(np.where(of // 64 == half, one, np.uint64(0)), begin) for half in (0, 1)]


def _listed(text: np.ndarray, keys: np.ndarray, n_texts: int) -> pa.ListArray:
    """The distinct keys of each text."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=n_texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[new].view(np.int64)))


def keyed_texts(batch: pa.RecordBatch, counts: np.ndarray, evaluation: bool, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """``(uid, n, bits_a, bits_b, keys)``: the texts of a batch with their keys of one round, as evaluation or as training texts."""
    lists = batch.column("words")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat_all = np.asarray(lists.values).view(np.uint64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WORDS_AT_ONCE, "right")) - 1)
        flat, begin, n = flat_all[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1])
        segments, windows = segment_keys(flat, begin, n, counts), window_keys(flat, begin, n)
        plain, turned = (segments, windows) if evaluation else (windows, segments)
        text, keys = np.concatenate([plain[0], turned[0]]), np.concatenate([plain[1], turned[1] ^ TRAIN_LONGER])
        kept = (keys >> np.uint64(8)) % np.uint64(rounds) == turn
        bits = [pa.array(s.view(np.int64)) for s in signatures(flat, begin, counts)]
        yield pa.RecordBatch.from_arrays([batch.column("uid").slice(a, b - a), pa.array(n.astype(np.int32)), *bits, _listed(text[kept], keys[kept], b - a)], names=["uid", "n", "bits_a", "bits_b", "keys"])
        a = b


def shuffled(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """Both sides shuffled and merged. Sizes of keys and texts are unknown to the planner before they are exploded, so it must not choose to send a side whole."""
    return a.hint("merge").join(b.hint("merge"), on)


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(side, id, split, source, uid, chk)`` of ``(side, id, text, split, source)``, the last two if there, and its distinct texts ``(uid, chk, words, in_train, in_eval)``.

    A text is told from all others by two independent hashes of its canonical form, ``uid`` and ``chk``.
    """
    rows = rows.select(*[c for c in ("side", "id", "text", "split", "source") if c in rows.columns])
    bare = with_bare_form(rows, "text", "canon").drop("text")
    words = F.transform(F.filter(F.split("canon", " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    hashed = bare.withColumn("uid", F.xxhash64("canon")).withColumn("chk", F.xxhash64(F.lit("chk"), "canon")).withColumn("words", words)
    # Written once: canonicalising is the dearest step and its result is read for texts and for both sides' rows. Texts without a word go after it, since a filter before it would canonicalise twice.
    rows = written(hashed.drop("canon"))[0].where("size(words) > 0")
    texts = rows.groupBy("uid", "chk").agg(F.first("words").alias("words"), F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval"))
    return rows.drop("words"), texts


def word_counts(texts: DataFrame) -> np.ndarray:
    """How many distinct texts have a word of each hash bucket, over all texts; one number per bucket."""
    each = texts.select(F.explode(F.array_distinct(F.transform("words", lambda w: F.pmod(w.bitwiseAND(BUCKETS - 1), F.lit(BUCKETS))))).alias("b"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in each.groupBy("b").count().collect():
        counts[r["b"]] = r["count"]
    return counts


def _coded(words: Column, turn: int) -> Column:
    """A text with one character for each word, for the built-in edit distance."""
    point = lambda w: F.lpad(F.hex(F.pmod(F.shiftrightunsigned(w, turn), F.lit(1_000_000)) + 0x10000), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, point), "")), "UTF-32")


def met_texts(texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(uid_eval, uid_train)``, all that may be near: different texts with a key in common whose lengths and signatures allow it; and the tables it is read from."""
    spark = texts.sparkSession
    texts = texts.where("size(words) >= 3")
    counts = word_counts(texts)
    sent, rounds = spark.sparkContext.broadcast(counts), min(MOST_ROUNDS, 1 + int(counts.sum()) // WORDS_A_ROUND)

    def keyed(name: str, turn: int) -> DataFrame:
        made = lambda batches: (m for batch in batches for m in keyed_texts(batch, sent.value, name == "eval", turn, rounds))
        side = texts.where(f"in_{name}").select("uid", "words").mapInArrow(made, "uid bigint, n int, bits_a bigint, bits_b bigint, keys array<bigint>")
        x = name[0]
        return side.select(F.col("uid").alias(f"uid_{name}"), F.col("n").alias(f"n_{x}"), F.col("bits_a").alias(f"a_{x}"), F.col("bits_b").alias(f"b_{x}"), F.explode("keys").alias("key"))

    # Words of a text that have no equal in its partner: as many as edits at most; fewer by what it is shorter.
    longer = "greatest(n_e, n_t)"
    left = lambda x, y: f"bit_count(a_{x} & ~a_{y}) + bit_count(b_{x} & ~b_{y}) <= n_{x} - {longer} + ({longer} + 2) div 3 - 1"
    possible = f"3 * least(n_e, n_t) > 2 * {longer} AND {left('e', 't')} AND {left('t', 'e')} AND uid_eval <> uid_train"
    found = []
    for turn in range(rounds):
        found.append(written(shuffled(keyed("eval", turn), keyed("train", turn), "key").where(possible).select("uid_eval", "uid_train").distinct(), free_shuffles=True))
    return reduce(DataFrame.unionByName, [met for met, _ in found]).distinct(), [path for _, path in found]


def near_pairs(texts: DataFrame, met: DataFrame) -> DataFrame:
    """``(uid_eval, chk_eval, uid_train, chk_train, distance, n_words)``: different texts with fewer edits than a third of the words of the longer one."""
    side = lambda name: texts.where(f"in_{name}").select(F.col("uid").alias(f"uid_{name}"), F.col("chk").alias(f"chk_{name}"), F.col("words").alias(f"words_{name}"))
    pairs = shuffled(shuffled(met, side("eval"), "uid_eval"), side("train"), "uid_train").withColumn("n_words", F.greatest(F.size("words_eval"), F.size("words_train")))
    bound = "cast((n_words + 2) div 3 - 1 as int)"
    for code, turn in (("c", 0), ("c2", 31)):
        pairs = pairs.withColumn(f"{code}_e", _coded(F.col("words_eval"), turn)).withColumn(f"{code}_t", _coded(F.col("words_train"), turn))
    pairs = pairs.withColumn("distance", F.expr(f"levenshtein(c_e, c_t, {bound})")).where("distance >= 0")
    return pairs.where(F.expr(f"levenshtein(c2_e, c2_t, {bound})") >= 0).select("uid_eval", "chk_eval", "uid_train", "chk_train", "distance", "n_words")


def linked_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the hashes of their distinct text, and all links ``(uid_eval, chk_eval, uid_train, chk_train, distance, n_words)``, exact ones with distance 0."""
    members, texts = distinct_texts(rows)
    texts, texts_at = written(texts, free_shuffles=True)
    exact = texts.where("in_train AND in_eval").select(F.col("uid").alias("uid_eval"), F.col("chk").alias("chk_eval"), F.col("uid").alias("uid_train"), F.col("chk").alias("chk_train"), F.lit(0).alias("distance"), F.size("words").alias("n_words"))
    met, met_at = met_texts(texts)
    links, _ = written(exact.unionByName(near_pairs(texts, met)), free_shuffles=True)
    for path in (texts_at, *met_at):
        forgotten(rows.sparkSession, path)
    return members, links


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: every evaluation row with every training row that it is linked with, the smaller key first."""
    e = members.where("side = 'eval'").select(F.col("uid").alias("uid_eval"), F.col("chk").alias("chk_eval"), F.col("id").alias("id_eval"))
    t = members.where("side = 'train'").select(F.col("uid").alias("uid_train"), F.col("chk").alias("chk_train"), F.col("id").alias("id_train"))
    both = shuffled(shuffled(links, e, ["uid_eval", "chk_eval"]), t, ["uid_train", "chk_train"])
    return both.select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b"))


def overlap_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """Per split and source: rows, rows with an equal or a near training row, and pairs. Counted per distinct text before rows are joined."""
    train = members.where("side = 'train'").groupBy(F.col("uid").alias("uid_train"), F.col("chk").alias("chk_train")).agg(F.count("*").alias("n_train"))
    per = shuffled(links, train, ["uid_train", "chk_train"]).groupBy(F.col("uid_eval").alias("uid"), F.col("chk_eval").alias("chk")).agg(
        F.sum(F.when(F.col("distance") == 0, F.col("n_train")).otherwise(0)).alias("n_exact"), F.sum("n_train").alias("n_links")
    )
    rows = members.where("side = 'eval'").hint("merge").join(per.hint("merge"), ["uid", "chk"], "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("n_exact") > 0).alias("n_rows_exact"), F.count_if(F.col("n_links") > 0).alias("n_rows_overlapping"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_pairs")
    )
