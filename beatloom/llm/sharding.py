"""Reproducible shuffle of a table into shards by a Feistel permutation.

Rows are numbered by (doc_id, size, crc32 of the text); the number passes
through a keyed Feistel network whose domain is the least even power of two
that holds all rows, again and again until it falls below the row count
(cycle walking).  The result p gives ``shard = p mod n`` and ``slot = p div n``,
so any row's place can be computed, and inverted, from its number alone.  Law
``rows``: shards differ by one row at most.

Null texts have size 1 and crc 0; null ids are numbered first; rows equal in
id, size and crc are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.store import stored

# Odd multipliers of the round function.
MIX = (0x9E3779B1, 0x85EBCA77)
LOW32 = 0xFFFFFFFF


@dataclass(frozen=True)
class Feistel:
    """Keyed permutation of the numbers below ``n``."""

    n: int
    keys: tuple[int, ...] = (0x3C6EF372, 0x1B873593, 0x510E527F, 0x2545F491)

    @property
    def half_bits(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        y = (x * np.uint64(MIX[0]) + np.uint64(key)) & np.uint64(LOW32)
        y ^= y >> np.uint64(15)
        y = (y * np.uint64(MIX[1])) & np.uint64(LOW32)
        y ^= y >> np.uint64(13)
        return y & np.uint64((1 << self.half_bits) - 1)

    def _once(self, x: np.ndarray, keys: tuple[int, ...]) -> np.ndarray:
        h, mask = np.uint64(self.half_bits), np.uint64((1 << self.half_bits) - 1)
        left, right = x >> h, x & mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (right << h) | left  # halves swapped back: reversed keys invert it

    def _walk(self, x: np.ndarray, keys: tuple[int, ...]) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), keys)
        while (over := out >= np.uint64(self.n)).any():
            out[over] = self._once(out[over], keys)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, p: np.ndarray) -> np.ndarray:
        return self._walk(p, self.keys[::-1])


def row_numbers(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row) for every row, and the row count.

    Only the three numbers are range-partitioned, never the text; one offset
    per partition turns the local order into a global one.
    """
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    keys = ["doc_id", "size", "text_crc32"]
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),  # spreads rows repeated very often
    )
    ordered = (
        slim.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie")
        .withColumn("at", F.monotonically_increasing_id())
        .select(*keys, F.shiftrightunsigned("at", 33).alias("part"),
                F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
    )
    ordered = stored(ordered, "numbered")
    starts, n = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):
        starts[part] = n  # one number per partition of the exchange
        n += count
    if not starts:
        return ordered.select(*keys, F.col("local").alias("row")), 0
    offsets = ordered.sparkSession.createDataFrame(list(starts.items()), "part long, start long")
    rows = ordered.join(F.broadcast(offsets), "part").select(*keys, (F.col("start") + F.col("local")).alias("row"))
    return rows, n


def shuffle_to_shards(docs: DataFrame, n_shards: int = 8, keys: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    rows, n = row_numbers(docs)
    permutation = Feistel(max(n, 1), keys) if keys else Feistel(max(n, 1))

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(row.to_numpy()))

    return rows.withColumn("p", position("row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("p") % n_shards).cast("int").alias("shard"),
        F.expr(f"p div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
