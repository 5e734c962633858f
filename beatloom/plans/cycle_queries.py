"""Queries over cycle arrays; all but the template ones stay in the scan stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions import arrays as A
from beatloom.functions import edges as ED
from beatloom.functions import intervals as I
from beatloom.functions import raw_p as RAW
from beatloom.functions import shape as S
from beatloom.functions.st_segment import st_features as st_struct
from beatloom.operators import bridging as BR
from beatloom.operators import template as TP
from beatloom.operators.quantiles import percentiles
from beatloom.plans import tables as T
from beatloom.session import written
from beatloom.sources.recordings import from_samples

FS = T.NOMINAL_FS
REACH = 38  # 150 ms at the nominal rate


def _y():
    return F.col("y")


def _at_r():
    return F.col("r")


def _r(expr, name: str, digits: int = 6):
    return F.round(expr, digits).alias(name)


def _with_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycles(spark, sf_dir).withColumn("r", A.argmax_abs(_y()))


def _samples(df: DataFrame, array: str, name: str, digits: int = 6) -> DataFrame:
    """Long form (record, cycle, position, value) for comparison."""
    return df.select("record_id", "cycle", F.posexplode(array).alias("i", "v")).select(
        "record_id", "cycle", "i", _r(F.col("v"), name, digits))


def cycle_chord_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.cycles(spark, sf_dir).withColumn("d", A.chord_detrend(_y()))
    return _samples(out, "d", "y_detrended")


def cycle_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycles(spark, sf_dir).select("record_id", "cycle", _r(A.chord_slope(_y()), "cycle_trend", 8))


def cycle_linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.cycles(spark, sf_dir).withColumn("d", A.linear_detrend(_y()))
    return _samples(out, "d", "y_detrended")


def cycle_argmax_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R position: the largest excursion, or the centre when that one lies more
    than 50 ms away and the centre reaches 80 % of it."""
    c = _with_r(spark, sf_dir)
    mid = F.floor(F.size(_y()) / 2).cast("int")
    use_mid = (F.abs(_at_r() - mid) > 12) & (F.abs(A.at(_y(), mid)) >= 0.8 * F.abs(A.at(_y(), _at_r())))
    return c.select("record_id", "cycle", _at_r().alias("argmax_idx"), F.when(use_mid, mid).otherwise(_at_r()).alias("r_idx"))


def trough_before_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumn("q", A.trough_before(_y(), _at_r(), REACH))
    return c.select("record_id", "cycle", F.col("q").alias("q_idx"), _r(A.at(_y(), F.col("q")), "q_mv"))


def trough_after_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumn("s", A.trough_after(_y(), _at_r(), _at_r() + REACH))
    return c.select("record_id", "cycle", F.col("s").alias("s_idx"), _r(A.at(_y(), F.col("s")), "s_mv"))


def _first_second_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_r(spark, sf_dir).withColumns({
        "le": F.greatest(_at_r() - 10, F.lit(0)), "ri": F.least(_at_r() + 10, F.size(_y()) - 1),
    })


def first_diff_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _first_second_half(spark, sf_dir)
    s = S.slopes(_y(), F.col("le"), _at_r(), F.col("ri"), FS)
    return c.select("record_id", "cycle", *[_r(v, k) for k, v in s.items()])


def wave_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _first_second_half(spark, sf_dir)
    d = S.durations(F.col("le"), _at_r(), F.col("ri"), FS)
    return c.select("record_id", "cycle", *[_r(v, k) for k, v in d.items()])


def voltage_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _first_second_half(spark, sf_dir)
    return c.select(
        "record_id", "cycle", _r(A.trapezoid(_y()) / FS, "cycle_integral"),
        _r(S.voltage_integral(_y(), F.col("le"), F.col("ri"), FS), "r_voltage_integral_uv_ms", 3),
    )


def sharpness_p95_p2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycles(spark, sf_dir).select("record_id", "cycle", _r(S.sharpness(_y(), FS), "sharpness"))


def sharpness_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycles(spark, sf_dir).select(
        "record_id", "cycle",
        _r(S.sharpness(_y(), FS, "median", "mad"), "median_mad"),
        _r(S.sharpness(_y(), FS, "mean", "rms"), "mean_rms"),
    )


def cycle_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TP.templates(T.cycles(spark, sf_dir), ["record_id"])
    return t.select("record_id", F.posexplode("template").alias("i", "v")).select(
        "record_id", "i", _r(F.col("v"), "template"))


def r2_rmse_vs_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.cycles(spark, sf_dir)
    joined = c.join(TP.templates(c, ["record_id"]), "record_id")
    corr = A.correlation(_y(), F.col("template"))
    return joined.select(
        "record_id", "cycle", _r(corr * corr, "r_squared"), _r(A.rmse(_y(), F.col("template")), "rmse"))


def template_corr_var_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumn("inverted", A.at(_y(), _at_r()) < 0)
    # record variance from per-cycle moments: nothing exploded, nothing gathered
    m = c.select(
        "record_id", F.size(_y()).alias("n"), A.total(_y()).alias("s"),
        A.total(F.transform(_y(), lambda v: v * v)).alias("ss"),
    ).groupBy("record_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    stats = m.select("record_id", (F.col("ss") / F.col("n") - mean * mean).alias("signal_var"))
    out = TP.select_by_template(c, stats, ["record_id"], corr_thresh=0.70, var_thresh=1.0)
    return out.select("record_id", "cycle", _r(F.col("corr"), "corr"), _r(F.col("var"), "var", 8), "kept")


def fwhm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumn("h", A.at(_y(), _at_r()))
    c = c.withColumns({"e": A.half_height_edges(_y(), _at_r(), F.col("h")), "sigma": A.half_height_sigma(_y(), _at_r(), F.col("h"))})
    edge = S.fwhm_edges(_at_r(), F.col("sigma") * A.FWHM_PER_SIGMA, F.size(_y()))
    return c.select(
        "record_id", "cycle", F.col("e.left").alias("left_idx"), F.col("e.right").alias("right_idx"),
        _r(F.col("sigma"), "sigma"), *[v.alias(k) for k, v in edge.items()])


def key_point_voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltage, cycle-global index and time of three key points."""
    c = _first_second_half(spark, sf_dir)
    start = F.col("cycle") * F.size(_y())
    out = []
    for name, at in (("center", _at_r()), ("le", F.col("le")), ("ri", F.col("ri"))):
        out += [
            _r(A.at(_y(), at), f"{name}_voltage"), (start + at).alias(f"global_{name}_idx"),
            _r((start + at) / FS * 1000, f"{name}_ms", 3),
        ]
    return c.select("record_id", "cycle", *out)


def moving_average_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.cycles(spark, sf_dir).withColumn("g", A.gradient(_y()))
    out = out.withColumn("e", A.moving_average(F.transform("g", lambda v: v * v), 38))
    return _samples(out, "e", "energy", 8)


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.cycles(spark, sf_dir)
    return c.select("record_id", "cycle", F.explode(A.local_maxima(_y())).alias("i"))


def derivative_turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign changes of the first difference; the one with the largest
    magnitude is the picked peak."""
    c = T.cycles(spark, sf_dir).withColumn("points", A.turning_points(_y()))
    sized = F.transform("points", lambda i: F.struct(F.abs(F.get("y", i)).alias("a"), (-i).alias("k")))
    return c.select("record_id", "cycle", F.size("points").alias("n_points"),
                    (-F.array_max(sized)["k"]).alias("picked_idx"))


def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.cycles(spark, sf_dir)
    return c.select("record_id", "cycle", F.explode(A.zero_crossings(_y())).alias("i"))


def parabolic_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir)
    trio = (A.at(_y(), _at_r() - 1), A.at(_y(), _at_r()), A.at(_y(), _at_r() + 1))
    return c.select(
        "record_id", "cycle", "r",
        _r(A.parabolic_offset(*trio), "offset_doubled"), _r(A.parabolic_offset(*trio, scale=0.5), "offset_exact"))


def mad_noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the crest when it reaches 2 MAD of the samples outside +-5."""
    c = T.cycles(spark, sf_dir).withColumn("r", A.argmax(_y()))
    outside = F.concat(A.span(_y(), F.lit(0), _at_r() - 5), A.span(_y(), _at_r() + 6, F.size(_y())))
    c = c.withColumn("mad", A.mad_sigma(outside))
    keep = (F.col("mad") <= 1e-9) | (F.abs(A.at(_y(), _at_r())) >= 2.0 * F.col("mad"))
    return c.select("record_id", "cycle", "r", _r(F.col("mad"), "mad"), keep.alias("keep"))


def rolling_deviation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.cycles(spark, sf_dir).withColumn("dev", A.rolling_deviation(_y()))
    return c.select("record_id", "cycle", _r(A.median(F.col("dev")), "rolling_dev"))


def block_range_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycles(spark, sf_dir).select("record_id", "cycle", _r(A.block_range(_y()), "noise"))


def amp_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumns(
        {"q": A.trough_before(_y(), _at_r(), REACH), "s": A.trough_after(_y(), _at_r(), _at_r() + REACH)})
    h = {w: A.at(_y(), F.col(w)) for w in ("q", "r", "s")}
    return c.select(
        "record_id", "cycle",
        F.coalesce(I.keep_wave("Q", h["q"], h["r"], 0.5), F.lit(False)).alias("keep_q"),
        F.coalesce(I.keep_wave("S", h["s"], h["r"], 0.5), F.lit(False)).alias("keep_s"),
        _r(I.amplitude_tier(h["r"]), "min_height", 8),
    )


def pairwise_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir).withColumns(
        {"q": A.trough_before(_y(), _at_r(), REACH), "s": A.trough_after(_y(), _at_r(), _at_r() + REACH)})
    r, s, q = A.at(_y(), _at_r()), A.at(_y(), F.col("s")), A.at(_y(), F.col("q"))
    return c.select(
        "record_id", "cycle", _r(I.pairwise_difference(r, s), "r_minus_s"),
        _r(I.pairwise_difference(r, q, "absolute"), "abs_r_minus_q"))


def t_search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and stop of the T search behind R and the QRS end, in samples."""
    c = _with_r(spark, sf_dir).withColumn("s", F.coalesce(A.trough_after(_y(), _at_r(), _at_r() + REACH), _at_r()))
    ms = lambda v: round(v * FS / 1000)
    start = F.greatest(_at_r() + ms(100), F.col("s") + ms(20))
    stop = F.greatest(F.least(_at_r() + ms(450), F.size(_y())), start + ms(100))
    return c.select("record_id", "cycle", start.alias("t_start"), F.least(stop, F.size(_y())).alias("t_stop"))


def st_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = lambda expr: expr.cast("int")
    base = F.col("cycle")
    c = T.cycles(spark, sf_dir).withColumns({
        "s_ri": idx(base % 13 + 30), "t_le": idx(base % 13 + 33 + base % 23),
        "p_ri": F.when(base % 4 != 0, idx(base % 9 + 5)), "q_le": idx(base % 7 + 18),
    })
    st = st_struct(_y(), F.col("s_ri"), F.col("t_le"), F.col("p_ri"), F.col("q_le"), FS, j_offset_ms=40.0)
    c = c.withColumn("st", st)
    return c.select("record_id", "cycle", *[
        _r(F.col(f"st.{n}"), n) for n in ("ST_elevation_mv", "ST_slope_mv_per_s", "ST_deviation_mv")])


def snr_adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_r(spark, sf_dir)
    h, noise = A.at(_y(), _at_r()), A.block_range(_y())
    return c.select(
        "record_id", "cycle",
        _r(S.snr_threshold(h, noise, 0.15), "threshold", 8),
        _r(S.snr_threshold(h, noise, 0.15, repaired=True), "threshold_repaired", 8))


def epoch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric windows around R cut across cycle borders.

    Sixteen consecutive cycles form one 1024-sample recording.  Each cycle needs
    only its two neighbours, reached by an equi-join on (recording, ordinal)
    after copying every cycle to the ordinals beside it.
    """
    c = T.cycles(spark, sf_dir).select(
        F.floor(F.col("cycle") / 16).alias("record_id"), (F.col("cycle") % 16).cast("int").alias("k"), "y")
    c = c.withColumn("r", A.argmax_abs(_y()))
    n = F.size(_y())
    mean_rr = c.groupBy("record_id").agg(
        F.min(F.col("k") * n + _at_r()).alias("first"), F.max(F.col("k") * n + _at_r()).alias("last"),
        F.count(F.lit(1)).alias("beats"),
    ).where("beats >= 2").select(
        "record_id",
        F.bround((F.col("last") - F.col("first")) / (F.col("beats") - 1) / 2).cast("int").alias("half"))
    spread = c.select("record_id", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("at"),
                      "k", "r", "y")
    around = spread.groupBy("record_id", "at").agg(  # at most three rows per group
        F.array_sort(F.collect_list(F.struct("k", "y"))).alias("parts"),
        F.max(F.when(F.col("k") == F.col("at"), F.col("r"))).alias("r"),
    ).where(F.col("r").isNotNull())
    joined = F.flatten(F.transform("parts", lambda p: p["y"]))
    lead = F.when(F.get("parts", F.lit(0))["k"] < F.col("at"), F.size(F.get("parts", F.lit(0))["y"])).otherwise(0)
    cut = around.join(mean_rr, "record_id").withColumns({"_all": joined, "_r": lead + F.col("r")})
    whole = (F.col("_r") - F.col("half") >= 0) & (F.col("_r") + F.col("half") <= F.size("_all"))
    cut = cut.where(whole & (F.col("half") > 1)).withColumn(
        "epoch", A.span(F.col("_all"), F.col("_r") - F.col("half"), F.col("_r") + F.col("half")))
    return cut.select("record_id", F.col("at").alias("k"), "half", F.size("epoch").alias("n"),
                      _r(A.total(F.col("epoch")), "sum_y"), _r(F.get("epoch", F.lit(0)), "first_y"))


def max_slope_before_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest step in the 80 ms up to R, and its share of the cycle's."""
    c = _with_r(spark, sf_dir).withColumn("g", F.transform(A.gradient(_y()), F.abs))
    steep = F.array_max(A.span(F.col("g"), _at_r() - 20, _at_r() + 1))
    return c.select("record_id", "cycle", _r(steep, "max_slope"), _r(F.try_divide(steep, F.array_max("g")), "share"))


def adaptive_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prominence threshold 2.5 MAD, relaxed by sensitivity level."""
    base = 2.5 * A.mad_sigma(_y())
    return T.cycles(spark, sf_dir).select(
        "record_id", "cycle", *[_r(base * k, n) for n, k in (("standard", 1.0), ("high", 0.75), ("maximum", 0.6))])


def gaussian_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-wave model from the detected trough, crest and trough, and how well
    it explains the cycle before any fitting."""
    c = _with_r(spark, sf_dir).withColumns(
        {"q": A.trough_before(_y(), _at_r(), REACH), "s": A.trough_after(_y(), _at_r(), _at_r() + REACH)})
    wave = lambda i: F.struct(i.cast("double").alias("center"), A.at(_y(), i).alias("height"), F.lit(2.5).alias("sigma"))
    c = c.withColumn("waves", F.filter(F.array(wave(F.col("q")), wave(_at_r()), wave(F.col("s"))), lambda w: w["center"].isNotNull()))
    c = c.withColumn("model", F.transform(_y(), lambda v, i: A.gaussians(i.cast("double"), F.col("waves"))))
    return c.select("record_id", "cycle", _r(A.rmse(_y(), F.col("model")), "rmse"), _r(A.total(F.col("model")), "area"))


def dynamic_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room around the QRS in samples: 1-60 ms by the cycle's share of the 95th
    percentile of its record's slope energy."""
    e = T.cycles(spark, sf_dir).select("record_id", "cycle", A.mean(F.transform(A.gradient(_y()), F.abs)).alias("energy"))
    top = percentiles(e, ["record_id"], "energy", {"top": 0.95})
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("energy") / F.col("top")))
    out = e.join(top, "record_id")
    return out.select("record_id", "cycle", _r(share, "share"),
                      F.bround((1 + 59 * share) * FS / 1000).cast("int").alias("offset_samples"))


def p_last_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last P search ahead of the crest of every embedding, behind 1.5 times the
    local noise and the lower quartile of its record's heights as learnt noise."""
    c = _with_r(spark, sf_dir)
    seg = A.span(_y(), F.lit(0), _at_r())
    heights = c.select("record_id", F.abs(RAW.strongest(seg)["height"]).alias("size"))
    learnt = percentiles(heights, ["record_id"], "size", {"learnt_noise": 0.25})
    c = c.join(learnt, "record_id", "left")
    c = c.withColumn("p", RAW.search(_y(), F.lit(0), _at_r(), 1.5, F.lit(0), F.col("learnt_noise")))
    found = F.col("p.local") & F.col("p.learnt")
    return c.select("record_id", "cycle", "r", F.col("p.at").alias("candidate"), _r(F.col("p.height"), "height"),
                    F.coalesce("p.local", F.lit(False)).alias("local"), F.coalesce("p.learnt", F.lit(False)).alias("learnt"),
                    F.when(found, F.col("p.at")).alias("p_peak"))


def smooth_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the parabolas fitted over 20 ms, at every sample."""
    out = T.cycles(spark, sf_dir).withColumn("d", ED.smooth_derivative(_y(), FS))
    return _samples(out, "d", "slope")


def wave_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both edges of the crest of every cycle, by slope and baseline."""
    c = _with_r(spark, sf_dir)
    c = c.withColumns({side: ED.edge(_y(), _at_r(), FS, side) for side in ("left", "right")})
    parts = [p for side in ("left", "right") for p in (
        F.col(f"{side}.at").alias(f"{side}_edge"), F.col(f"{side}.found").alias(f"{side}_found"),
        _r(F.col(f"{side}.max_slope"), f"{side}_max_slope"), _r(F.col(f"{side}.baseline"), f"{side}_baseline"))]
    return c.select("record_id", "cycle", "r", *parts)


def _strip_chunks(strips: DataFrame) -> DataFrame:
    """Strips cut into chunks of 5 s with halos of 2 s."""
    samples = strips.select("record_id", "place", F.posexplode("y").alias("i", "y")).select(
        "record_id", F.lit(FS).alias("fs"), (F.col("place") + F.col("i")).alias("idx"), "y")
    return written(from_samples(samples, 5.0, 2.0))


def _core_samples(chunks: DataFrame) -> DataFrame:
    core = F.slice("y", F.col("lead") + 1, F.col("core"))
    at = F.col("start") + F.col("lead")
    return chunks.select("record_id", at.alias("at"), F.posexplode(core).alias("i", "v")).select(
        "record_id", (F.col("at") + F.col("i")).alias("idx"), _r(F.col("v"), "y"))


def baseline_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the strips less its running cubics of 750 ms and 2 s."""
    return _core_samples(BR.remove_baseline(_strip_chunks(T.strips(spark, sf_dir))))


def qrs_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the strips with bridges over their beats, one for each
    embedding: the largest excursion of its middle 16 samples."""
    strips = written(T.strips(spark, sf_dir))
    middle = A.span(_y(), F.lit(24), F.lit(40))
    beats = strips.select("record_id", (F.col("place") + 24 + A.argmax_abs(middle)).alias("r_idx"))
    return _core_samples(BR.remove_qrs(_strip_chunks(strips), beats))
