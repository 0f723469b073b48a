"""Problem 6: documents of unlike lengths in containers of fixed capacity, by minimum bin slack.

Lengths are counted in tokens of a public tokenizer. Documents are hashed by id and row into blocks of a bounded number of pieces, so that a repeated or null id fills no block by itself; each block is packed by itself, so no task ever holds
more. For each container the longest piece left is taken, and a subset-sum over the lengths left, kept as a bitset, finds
the multiset of lengths that fills the rest closest; the counts are read back from the bitsets.

Defined results: a document with no token (null, blank) needs no room: its container and position are null; one longer than the capacity is cut into full
containers and a rest that is packed like any piece; equal lengths are taken in the order of document ids; repeated rows are packed one by one; a plan whose capacity is null or below one packs
nothing; further columns don't matter.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.plans.session import checkpointed

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Pre-token pattern that the files of the byte-level vocabularies name as theirs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for a null id while a block is packed.
NO_ID = -(1 << 63)
PLACED = "plan_name string, capacity int, doc_id bigint, piece int, tokens bigint, container bigint, position int, start bigint"


@cache
def encoding(folder: str, name: str):
    """The tokenizer of a rank file, once per worker."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)`` for each row; 0 for null. The whole text is tokenized."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, name).encode_ordinary
        for batch in batches:
            tokens = pa.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, tokens bigint")


def closest_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make a sum as near to ``room`` as possible, not above it. ``lengths`` descend; their counts are in ``counts``.

    Bit s of a bitset says that s can be made. Each length is added by powers of two of its count; the bitsets before each
    addition are kept and read backwards. The search ends early if the room can be filled exactly.
    """
    reachable, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((reachable, length, take))
            reachable |= (reachable << length * take) & full
            left -= take
            part *= 2
        if reachable >> room & 1:
            break
    at = reachable.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] += take
    return chosen


def pack_block(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Containers for ``(doc_id, piece, tokens)``, each between 1 and ``capacity`` tokens: ``(doc_id, piece, tokens, container, position, start)``."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for doc, piece, tokens in sorted(pieces, reverse=True):
        by_length[tokens].append((doc, piece))
    counts = {n: len(x) for n, x in by_length.items()}
    lengths = sorted(counts, reverse=True)
    placed, container, first = [], 0, 0
    while True:
        while first < len(lengths) and not counts[lengths[first]]:
            first += 1
        if first == len(lengths):
            return placed
        longest = lengths[first]
        counts[longest] -= 1
        chosen = closest_fill([n for n in lengths[first:] if counts[n]], counts, capacity - longest) if longest < capacity else {}
        position = start = 0
        for length, many in ((longest, 1), *sorted(chosen.items(), reverse=True)):
            counts[length] -= many if (length, many) != (longest, 1) or position else 0
            for _ in range(many):
                doc, piece = by_length[length].pop()
                placed.append((doc, piece, length, container, position, start))
                position += 1
                start += length
        container += 1


def _filler(name: str, capacity: int):
    """Packs the pieces of one block; containers are numbered within the block."""

    def fill(group):
        rows = pack_block(list(zip(group["doc_id"].tolist(), group["piece"].tolist(), group["tokens"].tolist())), capacity)
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "tokens", "container", "position", "start"])
        out["container"] += int(group["block"].iloc[0]) << 32
        return out.assign(plan_name=name, capacity=capacity)[[c.split()[0] for c in PLACED.split(", ")]]

    return fill


def pack(counted: DataFrame, plans: list[tuple[str, int]], block_pieces: int = 16_384) -> DataFrame:
    """Container and position of each piece of each document of ``(doc_id, tokens)``, for each ``(plan_name, capacity)``.

    ``container`` is unique within a plan; ``piece`` counts the parts of a document that is cut; ``start`` is the piece's first token in its container.
    """
    # The number of a row in the written table tells rows of one id apart and doesn't change when a task is run again.
    counted = checkpointed(counted.select("doc_id", "tokens")).withColumn("_row", F.monotonically_increasing_id())
    n = counted.count()
    parts = []
    for name, capacity in plans:
        if not capacity or capacity < 1:
            continue
        blocks = max(1, -(-n // block_pieces))
        whole = F.floor(F.col("tokens") / capacity)
        rest = F.col("tokens") % capacity
        base = counted.select(F.lit(name).alias("plan_name"), F.lit(capacity).cast("int").alias("capacity"), "doc_id", "tokens", "_row")
        cut = base.where(f"tokens > {capacity}").withColumn("piece", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))))
        parts.append(
            cut.select("plan_name", "capacity", "doc_id", "piece", F.lit(capacity).cast("bigint").alias("tokens"),
                       (F.monotonically_increasing_id() + (1 << 62)).alias("container"), F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("start"))
        )
        parts.append(base.where("tokens = 0").select("plan_name", "capacity", "doc_id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("bigint").alias("start")))
        small = base.where(f"tokens > 0 AND (tokens <= {capacity} OR tokens % {capacity} > 0)").withColumn("piece", F.when(F.col("tokens") > capacity, whole).otherwise(0).cast("int"))
        small = small.withColumn("tokens", F.when(F.col("tokens") > capacity, rest).otherwise(F.col("tokens"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(blocks)).cast("int")).drop("_row")

        # Ids stay whole numbers in pandas only without nulls.
        packed = small.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("block").applyInPandas(_filler(name, capacity), PLACED)
        parts.append(packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))
    if not parts:
        return counted.sparkSession.createDataFrame([], PLACED)
    whole_frame = parts[0]
    for p in parts[1:]:
        whole_frame = whole_frame.unionByName(p)
    return whole_frame


def fill_report(placed: DataFrame) -> DataFrame:
    """Per plan: containers, documents cut, tokens, and the share of the containers' room that is used."""
    per = placed.where("container IS NOT NULL").groupBy("plan_name", "capacity", "container").agg(F.sum("tokens").alias("used"), F.count_if(F.col("piece") > 0).alias("cut"))
    return per.groupBy("plan_name", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("cut").alias("n_cuts"), (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("fill"), F.max("used").alias("fullest")
    )


def pack_checks(placed: DataFrame) -> DataFrame:
    """Per plan: pieces' documents, containers above their capacity, and documents cut though they fit, which both must be none."""
    per = placed.where("container IS NOT NULL").groupBy("plan_name", "capacity", "container").agg(F.sum("tokens").alias("used")).groupBy("plan_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_over"))
    docs = placed.groupBy("plan_name", "capacity", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    docs = docs.groupBy("plan_name").agg(F.count("*").alias("n_docs"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("n_cut_small"))
    return docs.join(per, "plan_name", "left").select("plan_name", "n_docs", "n_cut_small", F.coalesce("n_over", F.lit(0)).alias("n_over"))
