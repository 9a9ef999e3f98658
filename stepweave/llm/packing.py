"""Texts of varying length into containers of fixed capacity, never splitting one that fits.

Hierarchical residual packing. Every partition packs its own items best-fit (longest first,
each into the fullest container that still takes it). Containers filled to NEARLY_FULL are
done; the others become items themselves and are packed again, FAN_IN partitions together,
then FAN_IN of those, until one group is left or a round gains nothing. Only sizes travel.

Defined results: a null text is no item; an empty one has no tokens but takes the room of
one, so that no container holds more items than its capacity; a text longer than the
capacity gives pieces of exactly the capacity, each a container of its own, and a last piece
that is packed like a text. Repeated ids are items of their own, told apart by `item`.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.cluster import cut, spread

CAPACITY, NEARLY_FULL, FAN_IN = 2048, 0.98, 16
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: A round with more open containers than this per group joins fewer groups, so that a task's share stays bounded; parameter of pack.
GROUP_ROWS = 500_000

# Fixed value: the pre-tokenizing pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(folder: str, vocabulary: str):
    """The tokenizer, loaded once per Python worker (tiktoken's own registry outlives a task), from the file sent along or else the folder."""
    import os

    import tiktoken.registry

    name = f"{folder}/{vocabulary}"
    if name not in tiktoken.registry.ENCODINGS:
        sent = SparkFiles.get(vocabulary) if SparkFiles._is_running_on_worker else name
        with open(sent if os.path.exists(sent) else name, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        tiktoken.registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tiktoken.registry.ENCODINGS[name]


def token_count(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, spark: SparkSession | None = None) -> Callable[[str], int]:
    """Counts the tokens of a whole text; with spark, the vocabulary's file travels to the executors."""
    if spark is not None:
        spark.sparkContext.addFile(f"{folder}/{vocabulary}")

    def count(text: str) -> int:
        return len(_encoding(folder, vocabulary).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))

    return count


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(container of each item, fill of each container), items taken longest first."""
    where, fills = [0] * len(sizes), []
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, container = rooms.pop(at)
        else:
            room, container = capacity, len(fills)
            fills.append(0)
        where[i] = container
        fills[container] += sizes[i]
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], container))
    return where, fills


def local_containers(documents: DataFrame, count: Callable[[str], int], capacity: int) -> DataFrame:
    """Every piece with the container its partition gave it: doc_id, item, piece_no, token_start, token_end, container, room_taken, fill, part."""
    schema = "doc_id bigint, item bigint, piece_no int, token_start bigint, token_end bigint, container string, fill int, part int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        item = 0
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text):
                n = count(text)
                whole = max(0, n - 1) // capacity
                key = (part << 40) + item
                item += 1
                for p in range(whole):
                    rows.append((doc_id, key, p, p * capacity, (p + 1) * capacity))
                rows.append((doc_id, key, whole, whole * capacity, n))
        where, fills = best_fit([max(1, r[4] - r[3]) for r in rows], capacity)
        for i in range(0, len(rows), 20_000):
            out = [(*r, f"0-{part}-{w}", fills[w], part) for r, w in zip(rows[i : i + 20_000], where[i : i + 20_000])]
            df = pd.DataFrame(out, columns=["doc_id", "item", "piece_no", "token_start", "token_end", "container", "fill", "part"])
            df["doc_id"] = df["doc_id"].astype("Int64")
            yield df

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")).mapInPandas(run, schema)


def _again(round_no: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the open containers of one group as items."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "container"], ascending=[False, True])
        part = int(pdf.part.iloc[0])
        where, fills = best_fit(pdf.fill.astype(int).tolist(), capacity)
        return pd.DataFrame({"container": pdf.container, "into": [f"{round_no}-{part}-{w}" for w in where], "fill": [fills[w] for w in where], "part": part})

    return run


def pack(documents: DataFrame, count: Callable[[str], int] | None = None, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, item, piece_no, token_start, token_end, container of every piece of every text.

    Which texts share a container depends on how rows lie in partitions; that none is split
    without need and none overfull does not.
    """
    pieces = cut(local_containers(documents, count or token_count(spark=documents.sparkSession), capacity))
    moves = None
    level = pieces.where(F.col("fill") < int(nearly_full * capacity)).select("container", "fill", "part").distinct()
    level, before, round_no = cut(level), None, 0

    while True:
        row = level.agg(F.count("*").alias("n"), F.countDistinct("part").alias("groups"), F.max("part").alias("last")).first()
        if row.n < 2 or (round_no and (row.groups < 2 or row.n > 0.995 * before)):
            break
        before, round_no = row.n, round_no + 1
        width = max(1, min(fan_in, int(group_rows * row.groups / row.n))) if row.groups > 1 else 1

        packed = cut(level.withColumn("part", (F.col("part") / width).cast("int")).groupBy("part").applyInPandas(_again(round_no, capacity), "container string, into string, fill int, part int"))
        step = packed.select(F.col("container").alias("from"), "into")
        if moves is None:
            moves = step
        else:
            # a container that did not move in this round keeps its name
            moves = moves.withColumnRenamed("into", "mid").join(step.withColumnRenamed("from", "mid"), "mid", "left").select("from", F.coalesce("into", "mid").alias("into"))
            moves = cut(moves)
        level = cut(packed.where(F.col("fill") < int(nearly_full * capacity)).select(F.col("into").alias("container"), "fill", "part").distinct())

    out = pieces.select("doc_id", "item", "piece_no", "token_start", "token_end", "container")
    if moves is None:
        return out
    return out.join(moves.withColumnRenamed("from", "container"), "container", "left").select("doc_id", "item", "piece_no", "token_start", "token_end", F.coalesce("into", "container").alias("container"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by tenths of their capacity: tenth, n_containers, tokens."""
    fills = packed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
    return fills.groupBy(F.least(F.lit(9), F.floor(F.col("fill") * 10 / capacity)).cast("int").alias("tenth")).agg(F.count("*").alias("n_containers"), F.sum("fill").alias("tokens"))
