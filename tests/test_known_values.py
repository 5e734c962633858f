"""Known answers of series, interval, shape and ST features, and settings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.config import Settings
from beatloom.functions import arrays as A
from beatloom.functions import intervals as I
from beatloom.functions import shape as S
from beatloom.functions import waves as W
from beatloom.functions.st_segment import st_features
from beatloom.operators import hrv as H
from beatloom.operators import variability as V
from beatloom.operators.ordered import sequence
from beatloom.schema import feature_columns


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def hrv_of(spark, values, **kw):
    rows = [("a", i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "record_id string, i bigint, rr_ms double")
    return H.hrv(sequence(df, ["record_id"], ["i"], slices=1), **kw).first()


def test_hrv_known_answers(spark):
    r = hrv_of(spark, [1000] * 100, rounded=True)
    assert (r.average_heart_rate, r.sdnn, r.rmssd, r.nn50, r.pnn50, r.sd1, r.sd2) == (60, 0, 0, 0, 0, 0, 0)
    assert hrv_of(spark, [500] * 10, rounded=True).average_heart_rate == 120
    r = hrv_of(spark, [1000, 1060] * 4 + [1000])
    assert r.nn50 == 8 and r.pnn50 == 100
    assert hrv_of(spark, [1000, 1050]).nn50 == 0
    assert hrv_of(spark, [1000]) is None and hrv_of(spark, [None, None]) is None
    r = hrv_of(spark, [1000], min_count=1)
    assert r.average_heart_rate == 60 and r.sdnn is None and r.nn50 is None
    rng = np.random.default_rng(1)
    x = rng.normal(1000, 50, 100)
    r = hrv_of(spark, [*x[:50], None, *x[50:]])
    d = np.diff(x)
    assert r.rmssd == pytest.approx(np.sqrt(np.mean(d**2))) and r.sdnn == pytest.approx(x.std(ddof=1))
    assert r.sd1 == pytest.approx(r.rmssd / np.sqrt(2)) and r.sd2**2 == pytest.approx(2 * r.sdnn**2 - r.sd1**2)
    assert hrv_of(spark, x[:59], min_count=60) is None


def test_variability_known_answers(spark):
    rows = [("a", "c", 400.0)] * 100 + [("a", "one", 5.0), ("a", "two", 400.0), ("a", "two", 450.0), ("a", "zero", -10.0), ("a", "zero", 10.0)]
    df = spark.createDataFrame(rows, "record_id string, feature string, value double")
    got = {r.feature: r for r in V.variability_long(df, ["record_id"]).collect()}
    assert tuple(got["c"][2:]) == (0, 0, 0, 0, 0) and got["one"].std is None
    assert got["two"].range == 50 and got["zero"].cv is None


@pytest.mark.parametrize("qt,rr", [(400, 1000), (400, 800), (400, 1200), (450, 1000)])
def test_qtc(spark, qt, rr):
    r = one(spark, **I.qtc_all(F.lit(float(qt)), F.lit(float(rr))))
    s = rr / 1000
    assert tuple(r) == pytest.approx((qt / s**0.5, qt / s ** (1 / 3), qt + 154 * (1 - s)), abs=0.01)
    assert list(one(spark, **I.qtc_all(F.lit(400.0), F.lit(0.0)))) == [None] * 3


def test_intervals(spark):
    edge = dict(P_le=80, P_ri=120, Q_le=170, S_ri=230, T_le=320, T_ri=380)
    cols = {n: I.interval_ms(F.lit(float(edge[on[:4]])), F.lit(float(edge[off[:4]])), 1000.0, lo, hi)
            for n, (on, off, lo, hi) in I.INTERVALS.items()}
    r = one(spark, **cols)
    assert r.PR_interval_ms == 90 and r.QRS_interval_ms == 60
    gap = lambda a, b: one(spark, v=I.gap_ms(F.lit(a).cast("double"), F.lit(b).cast("double"), 1000.0, (0, 200))).v
    assert gap(100, 0) == 100 and gap(500, 0) is None and gap(None, 0) is None and gap(0, 100) is None


def test_st_expression_equals_kernel(spark):
    rng = np.random.default_rng(0)
    plateau = np.zeros(100)
    plateau[40:61] = 0.1
    ramp = np.zeros(100)
    ramp[40:61] = np.linspace(0, 0.2, 21)
    for y in (plateau, ramp, rng.normal(size=100)):
        args = [F.lit(v) for v in (40, 60, 20, 35)]
        r = one(spark, st=st_features(F.array(*map(F.lit, y.tolist())), *args, 250.0)).st
        want = W.st_measures(y, 40, 60, 20, 35, 250.0)
        np.testing.assert_allclose([r.ST_elevation_mv, r.ST_slope_mv_per_s, r.ST_deviation_mv], want, atol=1e-9)
    assert W.st_measures(plateau, 40, 60, 20, 35, 250.0)[[0, 2]] == pytest.approx([0.1, 0.1])
    assert W.st_measures(ramp, 40, 60, 20, 35, 250.0)[1] > 0
    assert np.isnan(W.st_measures(plateau, 60, 40, 20, 35, 250.0)).all()


def test_shape_expressions_equal_kernel(spark):
    rng = np.random.default_rng(3)
    curve = np.exp(-0.5 * ((np.arange(180) - 90) / 12.0) ** 2) + rng.normal(0, 0.01, 180)
    seg = curve[60:121]
    y = F.array(*map(F.lit, seg.tolist()))
    r = one(spark, sharp=A.let(A.savgol(y, 7, 3), lambda a: S.sharpness(a, 250.0)), sigma=A.half_height_sigma(y, F.lit(30), F.lit(float(seg[30]))),
            mad=A.mad_sigma(y), block=A.block_range(y), area=A.trapezoid(y))
    from beatloom.functions import dsp as D
    assert r.sharp == pytest.approx(W.sharpness(seg, 250.0, "p95", "p2p"))
    assert r.sigma == pytest.approx(W.half_height_sigma(seg, 30, seg[30]))
    assert r.mad == pytest.approx(D.mad_sigma(seg)) and r.block == pytest.approx(D.block_range(seg))
    assert r.area == pytest.approx(np.trapezoid(seg))


def test_fit_metrics(spark):
    arr = lambda *v: F.array(*map(F.lit, map(float, v)))
    r = one(spark, a=A.correlation(arr(1, 2, 3), arr(2, 4, 6)), b=A.correlation(arr(1, 2, 3), arr(3, 2, 1)),
            c=A.rmse(arr(1, 2, 3), arr(2, 3, 4)), d=A.correlation(arr(1, 1, 1), arr(1, 2, 3)), e=A.rmse(arr(5), arr(5)))
    assert tuple(r) == pytest.approx((1, -1, 1, None, 0))


@pytest.mark.parametrize("bad", [
    {"epoch_corr_thresh": 1.5}, {"epoch_var_thresh": 0}, {"amp_min_ratio": {"X": 0.1}}, {"amp_min_ratio": {"P": 1.0}},
    {"snr_mad_multiplier": {"P": 0}}, {"snr_exclusion_ms": {"T": -1}}, {"snr_apply_savgol": {"P": 1}}, {"savgol_window_pts": 4},
    {"savgol_polyorder": 7}, {"bound_factor": 1.0}, {"maxfev": 0}, {"detrend_window_ms": 0}, {"wavelet_base_offset_ms": 60},
    {"rr_bounds_ms": (5, 5)}, {"pp_bounds_ms": (9, 1)}, {"threshold_fraction": 0}, {"duration_min_ms": 0},
    {"shape_max_window_ms": {"P": 0}}, {"shape_diff_mode": "x"}, {"sharp_stat": "x"}, {"sharp_amp_norm": "x"},
    {"rpeak_method": "x"}, {"rpeak_bpm_bounds": (9, 1)}, {"rpeak_rr_frac_second_pass": 1.0},
    {"pwave_bandpass_low_hz": 20.0}, {"local_baseline_window_fraction": 0}, {"seed_mode": "x"},
])
def test_settings_reject(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_settings_presets():
    human, mouse = Settings.for_human(), Settings.for_species("mouse")
    assert human.rr_bounds_ms == (300, 1800) and mouse.duration_min_ms == 2
    assert human.sha256() == Settings.for_human().sha256() != mouse.sha256()
    assert Settings(version="a") == Settings(version="b")
    with pytest.raises(ValueError):
        Settings.for_species("cat")
    with pytest.raises(ValueError):
        Settings.for_species("human", no_such_field=1)
    assert len(feature_columns()) == 185
