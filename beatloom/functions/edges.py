"""Where a wave leaves or rejoins its baseline, as expressions over one cycle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom.functions import arrays as A

# Fixed values of the walk.
SMOOTHING_MS = 20.0
DEGREE = 2
REACH_MS = 200.0
SLOPE_SHARE = 0.2       # of the steepest slope in reach
BASELINE_MS = 60.0
LEVEL_SHARE = 0.05      # of the steepest slope: how near the baseline an edge lies


def _samples(ms: float, fs: float) -> int:
    return int(round(ms * fs / 1000.0))


def smoothing_width(fs: float, window_ms: float = SMOOTHING_MS) -> int:
    """Odd number of samples, three at least."""
    return max(3, _samples(window_ms, fs)) | 1


def smooth_derivative(y: Column, fs: float, window_ms: float = SMOOTHING_MS) -> Column:
    """Slope per sample of the locally fitted parabolas; NULL for arrays
    shorter than the smoothing window, which have no fit."""
    width = smoothing_width(fs, window_ms)
    return F.when(F.size(y) >= width, A.gradient(A.savgol(y, width, DEGREE)))


def _whole(y: Column) -> Column:
    """Without missing samples."""
    return ~F.coalesce(F.exists(y, lambda v: v.isNull() | F.isnan(v)), F.lit(True))


def edge(
    y: Column, center: Column, fs: float, side: str, reach_ms: float = REACH_MS,
    slope_share: float = SLOPE_SHARE, baseline_ms: float = BASELINE_MS,
) -> Column:
    """Struct (at, max_slope, baseline, found) of the edge on the ``left`` or
    ``right`` of a centre.

    From the centre outwards, the first sample whose smoothed slope is at most
    ``slope_share`` of the steepest in reach and whose level lies within a
    twentieth of that slope of the baseline, the median of the ``baseline_ms``
    beyond reach.  The centre is clamped to the array and is itself the answer
    (not ``found``) where no sample qualifies, the reach is shorter than the
    smoothing window or flat, or samples in either stretch are missing.  NULL for an
    empty or missing array or centre.
    """
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    reach, beyond, last = _samples(reach_ms, fs), _samples(baseline_ms, fs), F.size(y) - 1
    mid = F.greatest(F.lit(0), F.least(center, last)).cast("int")
    if side == "left":
        start, stop = F.greatest(mid - reach, F.lit(0)), mid
        base = A.span(y, start - beyond, start + 1)
    else:
        start, stop = mid, F.least(mid + reach, last)
        base = A.span(y, stop, stop + beyond + 1)
    cut = F.struct(start.alias("start"), A.span(y, start, stop + 1).alias("seg"), base.alias("base"))

    def sloped(c: Column) -> Column:
        sound = _whole(c["seg"]) & _whole(c["base"])
        return F.struct(c["start"].alias("start"), c["seg"].alias("seg"), F.when(sound, smooth_derivative(c["seg"], fs)).alias("d"),
                        F.when(sound, A.median(c["base"])).alias("baseline"))

    def limited(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["seg"].alias("seg"), c["d"].alias("d"), c["baseline"].alias("baseline"),
                        F.array_max(F.transform(c["d"], F.abs)).alias("max_slope"))

    def walked(c: Column) -> Column:
        near = lambda k: (F.abs(F.get(c["d"], k)) <= slope_share * c["max_slope"]) \
            & (F.abs(F.get(c["seg"], k) - c["baseline"]) <= LEVEL_SHARE * c["max_slope"])
        places = F.when(c["max_slope"] > 0, F.filter(F.sequence(F.lit(0), F.size(c["seg"]) - 1), near))
        first = F.array_max(places) if side == "left" else F.array_min(places)
        at = F.coalesce((c["start"] + first).cast("int"), mid)
        return F.struct(at.alias("at"), c["max_slope"].alias("max_slope"), c["baseline"].alias("baseline"), first.isNotNull().alias("found"))

    there = (F.size(y) > 0) & center.isNotNull()
    return F.when(there, A.let(A.let(A.let(cut, sloped), limited), walked))
