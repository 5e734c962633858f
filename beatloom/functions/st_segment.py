"""ST elevation, slope and deviation of a cycle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom.functions import arrays as A

J_OFFSET_MS = 60.0
PRE_J_MS = 50.0


def st_features(
    y: Column, s_ri: Column, t_le: Column, p_ri: Column, q_le: Column, fs: Column | float,
    j_offset_ms: float = J_OFFSET_MS,
) -> Column:
    """``struct(ST_elevation_mv, ST_slope_mv_per_s, ST_deviation_mv)``.

    The baseline is the median of the PR segment, else of the 50 ms before the
    J point, else of the cycle.
    """
    n = F.size(y)
    inside = lambda i: (i >= 0) & (i < n)
    valid = inside(s_ri) & inside(t_le) & (s_ri < t_le)
    pr_ok = inside(p_ri) & inside(q_le) & (p_ri < q_le)
    samples = lambda ms: F.bround(F.lit(ms) * F.lit(fs) / 1000).cast("int")
    lead = samples(PRE_J_MS)
    baseline = F.coalesce(
        F.when(pr_ok, A.median(A.span(y, p_ri, q_le + 1))),
        F.when(s_ri > 0, A.median(A.span(y, s_ri - lead, s_ri))),
        A.median(y),
    )
    segment = A.savgol(A.span(y, s_ri, t_le + 1), 5, 2)
    point = F.least(samples(j_offset_ms), t_le - s_ri)
    parts = A.let(segment, lambda s: F.struct(
        F.get(s, point).alias("ST_elevation_mv"),
        (A.line_slope(s) * F.lit(fs)).alias("ST_slope_mv_per_s"),
        (F.get(s, point) - baseline).alias("ST_deviation_mv"),
    ))
    return F.when(valid, parts)
