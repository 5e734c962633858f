"""Ordered, per-record computations that survive one record holding most rows.

A plain ``Window.partitionBy(record)`` sends a whole record to one task.  Here
rows are cut along the ordering axis into slices, windows run inside
``(record, slice)``, and only slice summaries -- or the few edge rows a bounded
frame can reach -- travel between slices.  The plan is the same at every size;
a small table just has one slice.  NULL order values come first, as in any
ascending window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from beatloom.session import written

SLICE = "_slice"
LAST_SLICE = 1 << 62  # of NaN; NULL has the first


@dataclass(frozen=True)
class Sequence:
    """Rows of ``df`` ordered by ``order`` inside each ``keys`` group."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    # -- shaping ---------------------------------------------------------
    def with_df(self, df: DataFrame) -> "Sequence":
        return replace(self, df=df)

    def where(self, condition: Column) -> "Sequence":
        return self.with_df(self.df.where(condition))

    def with_columns(self, exprs: dict[str, Column]) -> "Sequence":
        return self.with_df(self.df.withColumns(exprs))

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)

    @property
    def _group(self) -> list[str]:
        return [*self.keys, SLICE]

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self._group).orderBy(*self.order)

    # -- bounded frames --------------------------------------------------
    def near(
        self,
        exprs: Callable[[WindowSpec], dict[str, Column]],
        before: int = 0,
        after: int = 0,
    ) -> "Sequence":
        """Add window columns whose frames reach at most ``before`` rows back
        and ``after`` rows ahead."""
        own = self.df.withColumn("_halo", F.lit(False))
        full = own
        if before:
            full = full.unionByName(self._edge_rows(before, forward=True))
        if after:
            full = full.unionByName(self._edge_rows(after, forward=False))
        out = full.withColumns(exprs(self._window()))
        return self.with_df(out.where(~F.col("_halo")).drop("_halo"))

    def _edge_rows(self, reach: int, forward: bool) -> DataFrame:
        """Rows within ``reach`` of a slice edge, copied to the slices on the
        other side that can see them (``forward``: later slices)."""
        group = self._group
        order = [F.col(c).desc() if forward else F.col(c).asc() for c in self.order]
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        edge = self.df.withColumn("_rank", rank).where(F.col("_rank") <= reach)
        # slices per record: their number is bounded by the slicing, not by rows
        sizes = self.df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        hop = F.lead if forward else F.lag
        w = Window.partitionBy(*self.keys).orderBy(SLICE)
        steps = [hop(F.struct(F.col(SLICE).alias("to"), F.col("_n").alias("n")), k).over(w) for k in range(1, reach + 1)]
        targets = sizes.select(*group, F.array(*steps).alias("_steps"))
        skipped = lambda k: sum((F.coalesce(F.col("_steps")[j]["n"], F.lit(0)) for j in range(k)), F.lit(0))
        reachable = F.array(*[
            F.when(
                F.col("_steps")[k].isNotNull() & (F.col("_rank") + skipped(k) <= reach),
                F.col("_steps")[k]["to"],
            )
            for k in range(reach)
        ])
        names = [c for c in self.df.columns if c != SLICE]
        return (
            _join(edge, targets, group)
            .select(*names, F.explode(reachable).alias(SLICE))
            .where(F.col(SLICE).isNotNull())
            .select(*self.df.columns, F.lit(True).alias("_halo"))
        )

    # -- unbounded-preceding frames -------------------------------------
    def last_valid_before(self, column: str, name: str) -> "Sequence":
        """Latest non-null ``column`` strictly before each row."""
        inside = F.last(column, ignorenulls=True).over(
            self._window().rowsBetween(Window.unboundedPreceding, -1)
        )
        tails = (
            self.df.groupBy(*self._group)
            .agg(F.max_by(
                F.col(column), F.when(F.col(column).isNotNull(), F.struct(*self.order))
            ).alias("_tail"))
        )
        carry = F.last("_tail", ignorenulls=True).over(
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = tails.select(*self._group, carry.alias("_carry"))
        out = _join(self.df, carried, self._group).withColumn(name, F.coalesce(inside, F.col("_carry")))
        return self.with_df(out.drop("_carry"))

    def running_sum(self, column: str, name: str) -> "Sequence":
        """Inclusive running total of ``column``."""
        inside = F.sum(column).over(
            self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        totals = self.df.groupBy(*self._group).agg(F.sum(column).alias("_total"))
        carry = F.sum("_total").over(
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = totals.select(*self._group, F.coalesce(carry, F.lit(0)).alias("_carry"))
        out = _join(self.df, carried, self._group).withColumn(name, F.col("_carry") + inside)
        return self.with_df(out.drop("_carry"))

    def position(self, name: str) -> "Sequence":
        """Zero-based ordinal of the row in its record."""
        seq = self.with_columns({"_one": F.lit(1).cast("long")}).running_sum("_one", name)
        return seq.with_df(seq.df.withColumn(name, F.col(name) - 1).drop("_one"))


def _join(rows: DataFrame, per_slice: DataFrame, group: list[str]) -> DataFrame:
    """Attach one row per (record, slice); NULL records and slices match."""
    named = per_slice.withColumnsRenamed({c: f"_on_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in group]
    return rows.join(named, same).drop(*[f"_on_{c}" for c in group])


def sequence(
    df: DataFrame, keys: list[str], order: list[str], slice_width: float | None = None, slices: int | None = None,
) -> Sequence:
    """Describe an ordered sequence.

    ``slice_width`` cuts the leading order column into stretches of that width
    in place.  Otherwise the rows are range-partitioned by record and order and
    written once, each partition being a slice: slices hold like numbers of
    rows, however the records are spread.  ``slices`` fixes their number.  Any
    monotone cut gives the same results.
    """
    if slice_width is not None:
        at = F.col(order[0]).cast("double") / F.lit(float(slice_width))
        place = F.when(at.isNull(), F.lit(-LAST_SLICE)).when(F.isnan(at), F.lit(LAST_SLICE)).otherwise(F.floor(at))
        cut = df.withColumn(SLICE, place.cast("long"))
    else:
        axis = [*keys, *order]
        ranged = df.repartitionByRange(slices, *axis) if slices else df.repartitionByRange(*axis)
        cut = written(ranged.withColumn(SLICE, F.spark_partition_id().cast("long")))
    return Sequence(cut, tuple(keys), tuple(order))
