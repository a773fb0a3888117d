"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by their place in a total order of id, size and checksum. A
keyed Feistel network permutes the numbers; as it permutes 0 to 4**b - 1, a number
that leaves the range of rows walks on until it is back inside (cycle walking).
The permuted number p gives shard ``p mod shards`` and slot ``p div shards``: both
follow from the row number alone, and ``row_numbers_at`` turns them back. Counts of
any two shards differ by at most one (the law "rows").

Defined results: a null text has size 1 and checksum 0; null ids come first. Rows
equal in id, size and checksum are interchangeable: they take neighbouring numbers.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import cut

ROUNDS = 4
SEED = 20260101
WORD = 0xFFFFFFFF
#: Odd multipliers of the round function, and of the key schedule.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
ROWS_PER_TASK = 2_000_000


def half_bits(rows: int) -> int:
    """Bits of each half: the smallest b (1 at least) with 4**b >= rows."""
    return max(1, ((max(rows, 1) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [(seed * MULTIPLIERS[0] + (r + 1) * MULTIPLIERS[1]) & WORD for r in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    t = (half + np.uint64(key)) & np.uint64(WORD)
    t = (t * np.uint64(MULTIPLIERS[0])) & np.uint64(WORD)
    t ^= t >> np.uint64(15)
    t = (t * np.uint64(MULTIPLIERS[1])) & np.uint64(WORD)
    t ^= t >> np.uint64(13)
    return t & np.uint64((1 << bits) - 1)


def _network(values: np.ndarray, bits: int, keys: list[int], backwards: bool) -> np.ndarray:
    left, right = values >> np.uint64(bits), values & np.uint64((1 << bits) - 1)
    if backwards:
        for key in reversed(keys):
            left, right = right ^ _mixed(left, key, bits), left
    else:
        for key in keys:
            left, right = right, left ^ _mixed(right, key, bits)
    return (left << np.uint64(bits)) | right


def permute(numbers: np.ndarray, rows: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """The places of row numbers 0 to rows - 1, or with ``backwards`` the numbers at places."""
    bits, keys = half_bits(rows), round_keys(seed)
    out = _network(np.asarray(numbers).astype(np.uint64), bits, keys, backwards)
    outside = np.flatnonzero(out >= rows)
    while outside.size:
        out[outside] = _network(out[outside], bits, keys, backwards)
        outside = outside[out[outside] >= rows]
    return out.astype(np.int64)


def row_numbers_at(shard: np.ndarray, slot: np.ndarray, rows: int, shards: int, seed: int = SEED):
    """The row numbers that stand in the given shards and slots."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), rows, seed, backwards=True)


def place(number: Column, rows: int, seed: int = SEED) -> Column:
    """The permuted row number, computed on Arrow batches."""

    @F.pandas_udf("long")
    def places(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), rows, seed))

    return places(number)


def number_rows(keys: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``keys`` with a gapless ``row_number`` from 0 in the given order, and the row count.

    Rows are range-partitioned and sorted, and written once so that both later
    passes see the same partitions. One small count per partition reaches the
    driver; no task sees more than its own range.
    """
    spark = keys.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // ROWS_PER_TASK))
    ranged = keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    place_in_task = F.monotonically_increasing_id()
    numbered = cut(
        ranged.select(
            *keys.columns,
            F.shiftright(place_in_task, 33).cast("int").alias("__task"),
            place_in_task.bitwiseAND((1 << 33) - 1).alias("__place"),
        )
    )
    counts = {r["__task"]: r["rows"] for r in numbered.groupBy("__task").agg(F.count("*").alias("rows")).collect()}
    starts, total = [], 0
    for task in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(task, 0)
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("__task"))
    return numbered.select(*keys.columns, (start + F.col("__place")).alias("row_number")), total


def assign_shards(
    df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, row_number, shard, slot.

    Only these narrow keys are shuffled, never the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, rows = number_rows(keys, ["id", "size", "text_crc32"])
    placed = numbered.withColumn("place", place(F.col("row_number"), rows, seed))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )
