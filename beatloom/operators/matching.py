"""Tolerance matching of detections against annotations."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.operators.ordered import sequence
from beatloom.session import cut_lineage, written

_MAX_ROUNDS = 10_000
RUN_LIMIT = 200_000  # points of a run that one task pairs at once


def hits(truth: DataFrame, found: DataFrame, keys: list[str], at: str, tolerance: int) -> DataFrame:
    """``truth`` with a flag ``hit``: some detection lies within ``tolerance``.

    No pairs are formed.  Detections are first reduced to the lowest and highest
    position in each tolerance-wide bucket; a truth in bucket b is hit when b
    holds any detection, when the highest of b-1 is near enough, or the lowest
    of b+1 is.  The join key is (keys, bucket), so a crowded record spreads over
    as many buckets as it spans.
    """
    width = max(int(tolerance), 1)
    bucket = F.floor(F.col(at) / F.lit(width)).cast("long")
    edges = (
        found.groupBy(*keys, bucket.alias("_b"))
        .agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .select(*keys, "_lo", "_hi", F.col("_b").alias("_own"),
                F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
        .groupBy(*keys, "_b")
        .agg(
            F.min(F.when(F.col("_own") >= F.col("_b"), F.col("_lo"))).alias("_up_lo"),
            F.max(F.when(F.col("_own") <= F.col("_b"), F.col("_hi"))).alias("_down_hi"),
            F.min(F.when(F.col("_own") == F.col("_b"), F.col("_lo"))).alias("_in_lo"),
            F.max(F.when(F.col("_own") == F.col("_b"), F.col("_hi"))).alias("_in_hi"),
        )
    )
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col(at)) <= tolerance, F.lit(False))
    return (
        truth.withColumn("_b", bucket)
        .join(edges, [*keys, "_b"], "left")
        .withColumn("hit", near("_up_lo") | near("_down_hi") | near("_in_lo") | near("_in_hi"))
        .drop("_b", "_up_lo", "_down_hi", "_in_lo", "_in_hi")
    )


def match_one_to_one(
    truth: DataFrame, found: DataFrame, keys: list[str], at: str, tolerance: int, slice_width: int, run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """Greedy closest-first pairing: (keys, truth_at, found_at, distance).

    Points further apart than ``tolerance`` part the record into runs, and runs
    of one kind are dropped.  The shortest pair of a run is always one of
    neighbours, so a heap over neighbours pairs a whole run at once; many runs
    share a task.  In runs of over ``run_limit`` points all points that are each
    other's nearest free partner are paired first, as such a pair is shorter
    than all pairs it competes with; what is left is parted into runs anew.
    Equal distances go to the earlier truth, then to the earlier detection.
    Positions are unique per record and kind.
    """
    width = max(int(slice_width), int(tolerance) + 1)
    point = lambda df, kind: df.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(kind).alias("_kind")).distinct()
    points = point(truth, 0).unionByName(point(found, 1))
    done: list[DataFrame] = []
    for _ in range(_MAX_ROUNDS):
        runs = written(_runs(points, keys, int(tolerance)))
        done.append(_paired(runs.where(F.col("_n") <= run_limit), keys, int(tolerance)))
        long = runs.where(F.col("_n") > run_limit).select(*keys, "_at", "_kind")
        if long.isEmpty():
            return reduce(DataFrame.unionByName, done)
        pairs = cut_lineage(_mutual_nearest(long, keys, tolerance, width))
        done.append(pairs)
        used = (
            pairs.select(*keys, F.col("truth_at").alias("_at"), F.lit(0).alias("_kind"))
            .unionByName(pairs.select(*keys, F.col("found_at").alias("_at"), F.lit(1).alias("_kind")))
        )
        points = cut_lineage(long.join(used, [*keys, "_at", "_kind"], "left_anti"))
    raise RuntimeError("matching did not settle")


def _runs(points: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Points of runs that hold both kinds, with the run and its size."""
    seq = sequence(points, keys, ["_at", "_kind"])
    gap = lambda w: {"_new": (F.coalesce(F.col("_at") - F.lag("_at").over(w), F.lit(tolerance + 1)) > tolerance).cast("long")}
    rows = seq.near(gap, before=1).running_sum("_new", "_run").rows().drop("_new")
    sizes = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_kind").alias("_kinds"))
    return rows.join(sizes.where("_kinds = 2").drop("_kinds"), [*keys, "_run"])


def _paired(runs: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Closest-first pairs of whole runs, a sorted partition at a time."""
    names = [*keys, "_run"]

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        run = (rows[names] != rows[names].shift()).any(axis=1).cumsum().to_numpy()
        t, f = closest_first(rows["_at"].to_numpy(), rows["_kind"].to_numpy(), run, tolerance)
        at = rows["_at"].to_numpy()
        out = rows[keys].iloc[t].reset_index(drop=True)
        return out.assign(truth_at=at[t], found_at=at[f], distance=np.abs(at[f] - at[t]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last run of a batch may go on in the next
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows[names] == rows[names].iloc[-1]).all(axis=1) if len(rows) else []
            held = rows[last]
            yield pairs(rows[~last])
        if held is not None:
            yield pairs(held)

    order = [*names, "_at", "_kind"]
    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    placed = runs.select(*order).repartition(*names).sortWithinPartitions(*order)
    return placed.mapInPandas(walk, f"{kinds}, truth_at long, found_at long, distance long")


def closest_first(at: np.ndarray, kind: np.ndarray, run: np.ndarray, tolerance: int) -> tuple[list[int], list[int]]:
    """Row numbers of truths and detections paired in runs of sorted points."""
    n = len(at)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    at, kind, run = at.tolist(), kind.tolist(), run.tolist()

    def pair(i: int, j: int) -> tuple | None:
        if i < 0 or j >= n or run[i] != run[j] or kind[i] == kind[j] or at[j] - at[i] > tolerance:
            return None
        t, f = (i, j) if kind[i] == 0 else (j, i)
        return at[j] - at[i], at[t], at[f], t, f

    heap = [p for i in range(n - 1) if (p := pair(i, i + 1))]
    heapq.heapify(heap)
    free, truths, founds = bytearray(b"\1") * n, [], []
    while heap:
        *_, t, f = heapq.heappop(heap)
        if not (free[t] and free[f]):
            continue
        free[t] = free[f] = 0
        truths.append(t)
        founds.append(f)
        i, j = min(t, f), max(t, f)
        low, high = before[i], after[j]
        if low >= 0:
            after[low] = high
        if high < n:
            before[high] = low
        if p := pair(low, high):
            heapq.heappush(heap, p)
    return truths, founds


def _mutual_nearest(points: DataFrame, keys: list[str], tolerance: int, width: int) -> DataFrame:
    home = F.floor(F.col("_at") / F.lit(width)).cast("long")
    reach = lambda d: F.floor((F.col("_at") + F.lit(d)) / F.lit(width)).cast("long")
    spread = points.withColumn("_home", home).withColumn(
        "_s", F.explode(F.array_distinct(F.array(home, reach(-tolerance), reach(tolerance))))
    )
    # both directions as running "last" over an ordered prefix: linear in rows
    group = Window.partitionBy(*keys, "_s")
    back = group.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = group.orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    kind_at = lambda k: F.when(F.col("_kind") == k, F.col("_at"))
    other = lambda w: F.when(F.col("_kind") == 0, F.last(kind_at(1), True).over(w)).otherwise(
        F.last(kind_at(0), True).over(w))
    seen = spread.withColumns({"_prev": other(back), "_next": other(ahead)})
    d_prev, d_next = F.col("_at") - F.col("_prev"), F.col("_next") - F.col("_at")
    prefer_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & (d_prev <= d_next))
    best = F.when(prefer_prev, F.col("_prev")).otherwise(F.col("_next"))
    chosen = (
        seen.where(F.col("_s") == F.col("_home"))
        .withColumn("_best", best)
        .where(F.abs(F.col("_best") - F.col("_at")) <= tolerance)
    )
    is_truth = F.col("_kind") == 0
    claims = chosen.select(
        *keys, "_kind",
        F.when(is_truth, F.col("_at")).otherwise(F.col("_best")).alias("truth_at"),
        F.when(is_truth, F.col("_best")).otherwise(F.col("_at")).alias("found_at"),
    )
    return (
        claims.groupBy(*keys, "truth_at", "found_at")
        .agg(F.count(F.lit(1)).alias("_sides"))
        .where(F.col("_sides") == 2)
        .select(*keys, "truth_at", "found_at", F.abs(F.col("found_at") - F.col("truth_at")).alias("distance"))
    )


def scores(n_truth: Column, n_found: Column, n_matched: Column) -> dict[str, Column]:
    """Precision, recall (percent) and F1 from counts; zero where undefined."""
    recall = F.coalesce(F.try_divide(n_matched * 100.0, n_truth), F.lit(0.0))
    precision = F.coalesce(F.try_divide(n_matched * 100.0, n_found), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {
        "precision": precision, "recall": recall, "f1": f1,
        "true_positives": n_matched,
        "false_positives": n_found - n_matched,
        "false_negatives": n_truth - n_matched,
    }
