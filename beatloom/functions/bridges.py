"""Slow baselines by running cubic fits and logistic bridges over QRS complexes,
on the samples of one haloed chunk."""

from __future__ import annotations

import numpy as np

# Fixed values.
BASELINE_MS = (750.0, 2000.0)   # widths of the two fits
LEVEL_MS = 10.0                 # stretch on either side whose mean a bridge meets
STEEPNESS = 6.0                 # the logistic runs from -6 to 6
LEFT_SHARE = 3                  # a bridge starts a third of RR ahead of R
RIGHT_MS = 80.0                 # and ends here behind R,
BEHIND_S_MS = 50.0              # or here behind the end of S where that is known
LONE_RR_MS = 800.0              # RR of a recording with one beat

DOUBT = 1e-12                   # share of an unknown level that may remain in a core


def half_widths(fs: float, n: int, widths_ms=BASELINE_MS) -> list[int]:
    """Half windows of the fits that apply to a recording of ``n`` samples: at
    least five samples wide and shorter than the recording."""
    widths = (int(round(ms * fs / 1000.0)) for ms in widths_ms)
    return [(w | 1) // 2 for w in widths if 5 <= w < n]


def running_cubic(x: np.ndarray, half: int) -> np.ndarray:
    """Middle values of the cubics fitted to ``half`` samples on each side; the
    outermost samples stand for those beyond the ends.

    A cubic's middle value needs the sums of y and k*k*y only.  Both come from
    running sums of y, j*y and j*j*y, so the cost does not depend on the window;
    j starts anew every four half windows, which keeps the sums exact enough.
    """
    n, width, step = x.size, 2 * half + 1, 4 * half
    blocks = -(-n // step)
    padded = np.pad(np.pad(x, half, mode="edge"), (0, blocks * step - n))
    rows = np.lib.stride_tricks.sliding_window_view(padded, step + 2 * half)[::step]
    j = np.arange(step + 2 * half, dtype=float) - 3 * half
    sums = (np.pad(np.cumsum(rows * j**p, axis=1), ((0, 0), (1, 0))) for p in range(3))
    m0, m1, m2 = (s[:, width:] - s[:, :-width] for s in sums)
    i = j[half : half + step]
    second = m2 - 2 * i * m1 + i * i * m0
    k = np.arange(-half, half + 1, dtype=float)
    k2, k4 = (k**2).sum(), (k**4).sum()
    return ((k4 * m0 - k2 * second) / (width * k4 - k2 * k2)).ravel()[:n]


def without_baseline(y, halves) -> np.ndarray:
    x = np.asarray(y, float)
    for half in halves:
        x = x - running_cubic(x, half)
    return x


def bridged(y, starts, stops, first: bool, last: bool, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, doubt) with every [start, stop) replaced, in order, by a
    logistic from the mean of the ``level`` samples ahead to that of those behind.

    Later bridges see earlier ones.  ``first`` and ``last`` say that the chunk
    begins or ends its recording; elsewhere a bridge that is cut by the end of
    the chunk has a level that is not known here.  ``doubt`` is the share of such
    unknown levels in each sample; it shrinks from bridge to bridge.
    """
    x = np.array(y, float)
    doubt, n = np.zeros(x.size), x.size
    for start, stop in zip(starts, stops):
        a, b = max(start, 0), min(stop, n)
        if a >= b:
            continue
        ahead = slice(max(a - level, 0), a) if a else slice(0, 1)
        behind = slice(b, min(b + level, n)) if b < n else slice(n - 1, n)
        before, after = x[ahead].mean(), x[behind].mean()
        unknown = doubt[ahead].mean() if first or start >= level else 1.0
        beyond = doubt[behind].mean() if last or stop + level <= n else 1.0
        # the rise is that of the whole bridge, of which the chunk may hold a part
        whole = stop - start
        rise = 1.0 / (1.0 + np.exp(-np.linspace(-STEEPNESS, STEEPNESS, whole)))[a - start : b - start]
        x[a:b] = (after - before) * rise + before
        doubt[a:b] = unknown * (1.0 - rise) + beyond * rise
    return x, doubt
