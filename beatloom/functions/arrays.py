"""Column builders over one cycle held as ``ARRAY<DOUBLE>``.

Indices are zero-based sample positions inside the cycle, NULL where undefined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom.functions.dsp import smoothing_weights

FWHM_PER_SIGMA = 2.3548  # fixed value used to turn a half-height width into sigma


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(y: Column, i: Column) -> Column:
    """Sample ``i``; NULL outside the array."""
    return F.when(i >= 0, F.get(y, i.cast("int")))


def span(y: Column, start: Column, stop: Column) -> Column:
    """Half-open slice ``[start, stop)`` clamped to the array."""
    lo = F.greatest(start, F.lit(0))
    hi = F.least(stop, F.size(y))
    cut = F.slice(y, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    return F.when(start.isNotNull() & stop.isNotNull(), cut)  # greatest and least skip NULLs


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v)


def mean(y: Column) -> Column:
    return F.try_divide(total(y), F.size(y))


def argmax(y: Column) -> Column:
    return F.nullif((F.array_position(y, F.array_max(y)) - 1).cast("int"), F.lit(-1))


def argmin(y: Column) -> Column:
    return F.nullif((F.array_position(y, F.array_min(y)) - 1).cast("int"), F.lit(-1))


def argmax_abs(y: Column) -> Column:
    return argmax(F.transform(y, F.abs))


def chord_detrend(y: Column) -> Column:
    """Subtract the straight line through the first and last sample."""
    n = F.size(y)
    slope = F.try_divide(F.get(y, n - 1) - F.get(y, F.lit(0)), (n - 1).cast("double"))
    return F.transform(y, lambda v, i: v - (F.get(y, F.lit(0)) + i * slope))


def chord_slope(y: Column) -> Column:
    """Trend removed by :func:`chord_detrend`, in units per sample."""
    n = F.size(y)
    return F.try_divide(F.get(y, n - 1) - F.get(y, F.lit(0)), (n - 1).cast("double"))


def line_slope(y: Column) -> Column:
    """Least-squares slope against the sample position."""
    n = F.size(y).cast("double")
    mid = (n - 1) / 2
    sxx = n * (n * n - 1) / 12
    sxy = total(F.transform(y, lambda v, i: v * (i - mid)))
    return F.try_divide(sxy, sxx)


def linear_detrend(y: Column) -> Column:
    def residual(a: Column) -> Column:
        mid = (F.size(a).cast("double") - 1) / 2
        line = F.struct(mean(a).alias("m"), line_slope(a).alias("b"))
        return let(line, lambda p: F.transform(a, lambda v, i: v - p["m"] - p["b"] * (i - mid)))

    return let(y, residual)


def trough_before(y: Column, r: Column, reach: int) -> Column:
    """Position of the minimum in ``[r - reach, r)``."""
    lo = F.greatest(r - reach, F.lit(0))
    return (lo + argmin(span(y, lo, r))).cast("int")


def trough_after(y: Column, r: Column, stop: Column) -> Column:
    """Position of the minimum in ``(r, stop)``."""
    return (r + 1 + argmin(span(y, r + 1, stop))).cast("int")


def first_difference(y: Column) -> Column:
    n = F.size(y)
    return F.zip_with(F.slice(y, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1), lambda b, a: b - a)


def gradient(y: Column) -> Column:
    """Central differences, one-sided at the two ends."""
    def central(a: Column) -> Column:
        n = F.size(a)
        ahead, behind = lambda i: F.least(i + 1, n - 1), lambda i: F.greatest(i - 1, F.lit(0))
        return F.transform(a, lambda v, i: F.try_divide(
            F.get(a, ahead(i)) - F.get(a, behind(i)), (ahead(i) - behind(i)).cast("double")))

    return let(y, central)


def trapezoid(y: Column) -> Column:
    """Integral with unit sample spacing."""
    n = F.size(y)
    return F.when(n >= 2, total(y) - (F.get(y, F.lit(0)) + F.get(y, n - 1)) / 2)


def interpolated(sorted_array: Column, prob: float) -> Column:
    """Percentile of an ascending array column (bounded arrays only)."""
    at = F.lit(float(prob)) * (F.size(sorted_array) - 1)
    low = F.try_element_at(sorted_array, (F.floor(at) + 1).cast("int"))
    high = F.try_element_at(sorted_array, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def median(y: Column) -> Column:
    return let(F.array_sort(y), lambda s: interpolated(s, 0.5))


def percentile(y: Column, prob: float) -> Column:
    return let(F.array_sort(y), lambda s: interpolated(s, prob))


def mad_sigma(y: Column) -> Column:
    """1.4826 times the median absolute deviation."""
    spread = lambda a: let(median(a), lambda m: median(F.transform(a, lambda v: F.abs(v - m))))
    return F.lit(1.4826) * let(y, spread)


def moving_average(y: Column, width: int) -> Column:
    """Centred box average of ``width`` samples, zeros beyond the ends, as in
    a same-length convolution with a box."""
    ahead = (width - 1) // 2
    behind = width - 1 - ahead
    box = lambda a: F.transform(a, lambda v, i: total(span(a, i - behind, i + ahead + 1)) / width)
    return let(y, box)


def positions(y: Column, test) -> Column:
    """Positions ``i`` of interior samples where ``test(y, i)`` holds."""
    n = F.size(y)
    inner = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: test(y, i))


def local_maxima(y: Column) -> Column:
    return positions(y, lambda a, i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1)))


def turning_points(y: Column) -> Column:
    """Interior positions where the first difference changes sign."""
    return positions(
        y,
        lambda a, i: F.signum(F.get(a, i) - F.get(a, i - 1)) != F.signum(F.get(a, i + 1) - F.get(a, i)),
    )


def zero_crossings(y: Column) -> Column:
    """Of each neighbouring pair with opposite signs, the sample nearer zero."""
    n = F.size(y)
    pairs = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    changes = F.filter(pairs, lambda i: F.get(y, i) * F.get(y, i + 1) <= 0)
    nearer = F.transform(
        changes, lambda i: F.when(F.abs(F.get(y, i)) < F.abs(F.get(y, i + 1)), i).otherwise(i + 1)
    )
    return F.array_sort(F.array_distinct(nearer))


def parabolic_offset(left: Column, mid: Column, right: Column, scale: float = 1.0) -> Column:
    """Sub-sample shift of a 3-point vertex, clamped to half a sample.

    ``scale=0.5`` is the analytic vertex; ``1.0`` doubles it before clamping,
    which is what published result tables were made with.
    """
    raw = F.try_divide(left - right, left - 2 * mid + right) * scale
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), raw))


def half_height_edges(y: Column, centre: Column, height: Column) -> Column:
    """``struct(left, right)``: nearest samples either side of ``centre`` no
    longer beyond half of ``height`` (towards its sign), else the array ends."""
    n = F.size(y)
    level, sign = height * 0.5, F.when(height >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    below = lambda i: F.get(y, i) * sign <= level * sign
    before = F.when(centre > 0, F.sequence(F.lit(0), centre - 1)).otherwise(F.array().cast("array<int>"))
    after = F.when(centre < n - 1, F.sequence(centre + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    left = F.coalesce(F.array_max(F.filter(before, below)), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(after, below)), n - 1)
    flat = F.get(y, centre) * sign <= level * sign
    return F.struct(
        F.when(flat, centre).otherwise(left).cast("int").alias("left"),
        F.when(flat, centre).otherwise(right).cast("int").alias("right"),
    )


def half_height_sigma(y: Column, centre: Column, height: Column) -> Column:
    """Gaussian sigma from the half-height width, at least one sample."""
    edges = half_height_edges(y, centre, height)
    width = edges["right"] - edges["left"]
    return F.when(width > 0, F.greatest(width / F.lit(FWHM_PER_SIGMA), F.lit(1.0)))


def rmse(y: Column, f: Column) -> Column:
    squares = F.zip_with(y, f, lambda a, b: (a - b) * (a - b))
    return F.sqrt(mean(squares))


def correlation(y: Column, f: Column) -> Column:
    """Pearson correlation; NULL when either side is constant."""
    def corr(m: Column) -> Column:
        return F.aggregate(
            F.zip_with(y, f, lambda a, b: F.struct(a.alias("y"), b.alias("f"))),
            F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
            lambda acc, p: F.struct(
                (acc["xy"] + (p["y"] - m["a"]) * (p["f"] - m["b"])).alias("xy"),
                (acc["xx"] + (p["y"] - m["a"]) * (p["y"] - m["a"])).alias("xx"),
                (acc["yy"] + (p["f"] - m["b"]) * (p["f"] - m["b"])).alias("yy"),
            ),
            lambda acc: F.try_divide(acc["xy"], F.sqrt(acc["xx"]) * F.sqrt(acc["yy"])),
        )
    return let(F.struct(mean(y).alias("a"), mean(f).alias("b")), corr)


def variance(y: Column) -> Column:
    """Population variance."""
    return let(mean(y), lambda m: mean(F.transform(y, lambda v: (v - m) * (v - m))))


def block_range(y: Column, width: int = 5) -> Column:
    """Mean of (max - min) over consecutive blocks of ``width`` samples."""
    n = F.size(y)
    starts = F.when(n >= 1, F.sequence(F.lit(0), n - 1, F.lit(width)))
    ranges = F.transform(starts, lambda s: F.array_max(span(y, s, s + width)) - F.array_min(span(y, s, s + width)))
    return mean(ranges)


def rolling_deviation(y: Column) -> Column:
    """1.4826 times a box-averaged absolute deviation from a box average; the
    box is the odd length nearest below sqrt(n), at least 3."""
    n = F.size(y)
    base = F.greatest(F.lit(3), F.bround(F.sqrt(n.cast("double"))).cast("int"))
    half = F.floor((base - 1) / 2).cast("int")
    width = 2 * half + 1
    box = lambda a, i: total(span(a, i - half, i + half + 1)) / width
    off = lambda a: F.transform(a, lambda v, i: F.abs(v - box(a, i)))
    again = lambda d: F.transform(d, lambda v, i: F.lit(1.4826) * box(d, i))
    return let(let(y, off), again)


def savgol(y: Column, width: int, degree: int) -> Column:
    """Savitzky-Golay smoothing; the half window at each end takes the value of
    the polynomial fitted to the outermost window.  Shorter arrays are kept."""
    weights, half = smoothing_weights(width, degree), width // 2

    def dot(row: int, a: Column, start: Column) -> Column:
        return sum((F.get(a, start + k) * float(w) for k, w in enumerate(weights[row])), F.lit(0.0))

    def smooth(a: Column) -> Column:
        n = F.size(a)

        def sample(v: Column, i: Column) -> Column:
            out = F.when((i >= half) & (i < n - half), dot(half, a, i - half))
            for k in range(half):
                out = out.when(i == k, dot(k, a, F.lit(0))).when(i == n - 1 - k, dot(width - 1 - k, a, n - width))
            return out

        return F.when(n >= width, F.transform(a, sample)).otherwise(a)

    return let(y, smooth)


def gaussians(x: Column, waves: Column) -> Column:
    """Sum of Gaussians at ``x`` for an array of (center, height, sigma)."""
    return F.aggregate(
        waves, F.lit(0.0),
        lambda acc, w: acc + w["height"] * F.exp(
            -((x - w["center"]) * (x - w["center"])) / (2 * w["sigma"] * w["sigma"])
        ),
    )
