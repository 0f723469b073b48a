"""Problem 7: passages of held-out texts inside documents.

The words of the held-out texts, normalised and numbered, are sent to the executors. Every window of a document that holds enough of an item's words in any order
is verified by the longest common subsequence of words; the others can't hold enough in order, so none is missed. Items are a stated query set: they are taken in blocks of a fixed
number of words, so what is sent never grows with the documents nor, beyond a block, with the items.

Defined results: a null or blank text, of a document or an item, has no words and takes part in no row; repeated documents and items are reported one by one; a document holding an item twice is reported
once, with the best passage, the first among equals; text of any length is scanned whole; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import bare_word_list

SCHEMA = "doc_id bigint, item_id bigint, matched int, item_words int, first_word int, last_word int"

_PAGE_LINE = re.compile(r"^[ \t]*[-–—][ \t]*\d{1,5}[ \t]*[-–—][ \t]*$\n?", re.M)
_DIVISION = re.compile(r"[-‐\u00ad‑][\u200b-\u200f\u2060\ufeff]*[ \t]*\r?\n[ \t]*(?=[^\W_]|:)")
_CUE = re.compile(r"\[[\d:.,…\s]*\]")


def running_text(text: str) -> str:
    """``text`` without page lines, time cues and word division at line ends."""
    if "\n" in text:
        text = _DIVISION.sub("", _PAGE_LINE.sub("", text))
    return _CUE.sub(" ", text) if "[" in text else text


def text_words(text: str | None) -> list[str]:
    """The words of the running text, by look; none for null."""
    return bare_word_list(running_text(text)) if text else []


class Item:
    """One held-out text: its words by number, those a passage must have, and how far a passage reaches."""

    def __init__(self, item_id: int, words: np.ndarray, share: float, slack: int):
        self.item_id, self.words, self.n, self.reach = item_id, words, len(words), len(words) + slack
        self.need = max(1, int(np.ceil(share * self.n)))

    def common(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: int) -> np.ndarray:
        """Length of the longest common subsequence with each ``flat[start:end]`` (bit-parallel, 64 words of the item a limb)."""
        k = np.arange(self.n)
        bits = np.zeros((-(-self.n // 64), numbers), np.uint64)
        np.bitwise_or.at(bits, (k // 64, self.words), np.uint64(1) << (k % 64).astype(np.uint64))
        rows = [np.full(len(starts), 2**64 - 1, np.uint64) for _ in bits]
        for step in range(int((ends - starts).max(initial=0))):
            at = starts + step
            word = np.where(at < ends, flat[np.minimum(at, len(flat) - 1)], 0)
            carry = np.zeros(len(starts), np.uint64)
            for limb, row in enumerate(rows):
                u = row & bits[limb][word]
                total = row + u
                over = total < u
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                rows[limb] = total | (row & ~u)
        return np.sum([np.bitwise_count(~row).astype(np.int64) for row in rows], axis=0)


class Batch:
    """The words of some documents, one document after another, with what all items need of them; word 0 is in no item."""

    def __init__(self, offsets: np.ndarray, flat: np.ndarray, numbers: int):
        self.offsets, self.flat, self.numbers = offsets, flat, numbers
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        key = self.owner * numbers + flat
        self.order = np.argsort(key, kind="stable")
        key, line = key[self.order], np.arange(len(flat))
        begins = np.concatenate([[True], key[1:] != key[:-1]])[: len(flat)]
        self.rank, self.nth = np.empty_like(line), np.empty_like(line)
        self.rank[self.order] = line
        #: How often the same word stands in the document before.
        self.nth[self.order] = line - np.maximum.accumulate(np.where(begins, line, 0))
        self.many = np.zeros(numbers, np.int64)

    def starts(self, item: Item) -> np.ndarray:
        """Every place where a word of the item begins a window that holds the words needed in any order, each counted as often as the item has it at most.

        No passage begins elsewhere: its first word in common is such a place.
        """
        words, counts = np.unique(item.words, return_counts=True)
        self.many[words] = counts
        at = np.flatnonzero((self.many > 0)[self.flat])
        low, high = at[: max(0, len(at) - item.need + 1)], at[item.need - 1 :]
        near = self.owner[low[(high - low < item.reach) & (self.owner[low] == self.owner[high])]]
        alive = np.zeros(len(self.offsets), bool)
        alive[near] = True
        at = at[alive[self.owner[at]]]
        # A word counts in the windows that begin after its last occurrence but as many as the item has.
        back = self.many[self.flat[at]]
        past = np.where(self.nth[at] >= back, self.order[np.maximum(self.rank[at] - back, 0)], -1)
        first = np.maximum(np.maximum(past, at - item.reach) + 1, self.offsets[self.owner[at]])
        held = np.cumsum(np.bincount(np.searchsorted(at, first), minlength=len(at))) - np.arange(len(at))
        self.many[words] = 0
        return at[held >= item.need]


def scan(doc_ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray, items: list[Item], numbers: int) -> list[tuple]:
    """All hits of one batch of documents; ``flat`` holds the numbers of their words, less than ``numbers``, one document after another."""
    hits: list[tuple] = []
    batch = Batch(offsets, flat, numbers)
    for item in items:
        starts = batch.starts(item)
        ends = np.minimum(starts + item.reach, offsets[batch.owner[starts] + 1])
        matched = item.common(flat, starts, ends, numbers)
        enough = matched >= item.need
        starts, ends, matched = starts[enough], ends[enough], matched[enough]
        order = np.lexsort((starts, -matched, batch.owner[starts]))
        docs, best = np.unique(batch.owner[starts][order], return_index=True)
        for d, k in zip(docs.tolist(), order[best].tolist()):
            base = int(offsets[d])
            hits.append((int(doc_ids[d]), item.item_id, int(matched[k]), item.n, int(starts[k]) - base, int(ends[k]) - base - 1))
    return hits


def find_passages(docs: DataFrame, items: DataFrame, share: float = 0.5, slack: int = 10, block_words: int = 200_000) -> DataFrame:
    """Each document and item where one passage of the document, at most ``slack`` words longer than the item, holds ``share`` of the item's words in order.

    The result is exact, however the words are scattered. ``docs`` has ``doc_id, text``; ``items`` has ``item_id, text``.
    Items are taken in blocks of about ``block_words`` words, each block a pass over the documents.
    """
    words = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    test = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    total = test.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}\p{M}]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    spark = docs.sparkSession

    def one(block: int) -> DataFrame:
        rows = test.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        texts = [(r["item_id"], ws) for r in rows if (ws := text_words(r["text"]))]
        sent = spark.sparkContext.broadcast(texts)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number: dict[str, int] = {}
            for _, ws in sent.value:
                for w in ws:
                    number.setdefault(w, len(number) + 1)
            held = [Item(i, np.array([number[w] for w in ws], np.int64), share, slack) for i, ws in sent.value]
            for batch in batches:
                if not batch.num_rows:
                    continue
                each = [[number.get(w, 0) for w in text_words(t)] for t in batch.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                flat = np.fromiter(chain.from_iterable(each), np.int64, int(offsets[-1]))
                hits = scan(np.asarray(batch.column("doc_id")), offsets, flat, held, len(number) + 1)
                if hits:
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        return words.mapInArrow(search, SCHEMA)

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])


def without_leaks(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item; documents without an id are kept."""
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
