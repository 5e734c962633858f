"""Exact percentiles per group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written


Spot = float | Callable[[Column], Column]


def upper_middle(n: Column) -> Column:
    """Position of the median of the upper half of ``n`` values."""
    half = F.floor(n / 2)
    return half + (n - half - 1) / F.lit(2.0)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, Spot]) -> DataFrame:
    """Linear-interpolated percentiles: one row per group, one column per name.

    Values collapse to (value, count) and are range-partitioned by group and
    value, so that a group of any size is spread; each partition counts up from
    where the ones before it end, and the rows that hold a wanted rank are
    picked.  Three exchanges whatever the size or the values: NaN ranks above
    infinity, missing values are left out, groups without values have no row.
    A share may also be a function from the number of values to the position.
    ``keys`` may be empty.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = written(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)  # one row per group and partition
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum")).select(
        *[F.col(k).alias(f"_on_{k}") for k in keys], F.col("_part").alias("_at"),
        F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    same = [F.col("_part") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]]
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ranked = placed.withColumn("_inside", inside).join(parts, same)
    end = F.col("_before") + F.col("_inside")

    def at(rank):
        """The value of this zero-based rank, in its one row."""
        return F.max(F.when((rank >= end - F.col("_n")) & (rank < end), F.col("_v")))

    def spot(p: Spot):
        return p(F.col("_total")) if callable(p) else F.lit(float(p)) * (F.col("_total") - 1)

    wanted = []
    for n, p in probs.items():
        wanted += [at(F.floor(spot(p))).alias(f"_a_{n}"), at(F.ceil(spot(p))).alias(f"_b_{n}")]
    picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *wanted)

    def between(n: str, p: Spot):
        a, b, share = F.col(f"_a_{n}"), F.col(f"_b_{n}"), spot(p) - F.floor(spot(p))
        endless = F.greatest(F.abs(a), F.abs(b)) == float("inf")  # where b - a may be undefined
        return F.when((share == 0) | (a == b), a).when(endless, a * (1 - share) + b * share).otherwise(a + (b - a) * share)

    return picked.where("_total is not null").select(*keys, *[between(n, p).alias(n) for n, p in probs.items()])
