"""Queries over ordered interval series and wave edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions import intervals as I
from beatloom.operators import hrv as H
from beatloom.operators import matching as M
from beatloom.operators import variability as V
from beatloom.operators.quantiles import percentiles
from beatloom.plans import tables as T
from beatloom.session import written

TOLERANCE_US = 30 * 60 * 1_000_000  # half an hour between event kinds


def _r(expr, name: str, digits: int = 6):
    return F.round(expr, digits).alias(name)


def rr_intervals_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between successive raw values as sample positions, gated."""
    rr = T.rr_series(spark, sf_dir)
    gaps = rr.near(
        lambda w: {"rr_interval_ms": I.gap_ms(F.col("t_us"), F.lag("t_us").over(w), 1_000_000.0, (300.0, 4e7))},
        before=1,
    )
    return gaps.rows().select("record_id", "event_id", _r(F.col("rr_interval_ms"), "rr_interval_ms", 3))


def rr_last_valid_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = T.rr_series(spark, sf_dir).with_columns(
        {"r_idx": F.when(F.col("event_type") != "error", F.col("t_us"))}
    )
    out = rr.last_valid_before("r_idx", "prev_r_idx")
    return out.rows().select(
        "record_id", "event_id", "prev_r_idx",
        (F.col("r_idx") - F.col("prev_r_idx")).alias("rr_us"),
    )


def pp_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous P position overwritten even when missing: a plain lag."""
    seq = T.rr_series(spark, sf_dir).with_columns(
        {"p_idx": F.when(F.col("event_type") != "error", F.col("t_us"))}
    )
    out = seq.near(lambda w: {"pp_us": F.col("p_idx") - F.lag("p_idx").over(w)}, before=1)
    return out.rows().select("record_id", "event_id", "pp_us")


def _hrv_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "record_id", "n_rr", _r(F.col("average_heart_rate"), "average_heart_rate"),
        _r(F.col("sdnn"), "sdnn"), _r(F.col("rmssd"), "rmssd"), "nn50",
        _r(F.col("pnn50"), "pnn50"), _r(F.col("sd1"), "sd1"), _r(F.col("sd2"), "sd2"),
    )


def hrv_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hrv_columns(H.hrv(T.gated_rr(spark, sf_dir)))


def hrv_min60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hrv_columns(H.hrv(T.gated_rr(spark, sf_dir), min_count=H.MIN_INTERVALS))


def rr_median_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals inside 0.92-1.16 of the record's median."""
    rr = T.gated_rr(spark, sf_dir)
    rows = rr.rows().where(F.col("rr_ms").isNotNull())
    med = percentiles(rows, ["record_id"], "rr_ms", {"median_rr": 0.5})
    return (
        rows.join(med, "record_id")
        .where(F.col("rr_ms").between(F.col("median_rr") * 0.92, F.col("median_rr") * 1.16))
        .select("record_id", "event_id", _r(F.col("rr_ms"), "rr_ms"), _r(F.col("median_rr"), "median_rr"))
    )


def poincare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = H.poincare_pairs(T.gated_rr(spark, sf_dir))
    return pairs.select("record_id", "event_id", _r(F.col("rr_ms"), "rr_n"), _r(F.col("rr_next"), "rr_next"))


def _neighbour_fill(spark: SparkSession, sf_dir: str, after: int) -> DataFrame:
    seq = T.rr_series(spark, sf_dir).with_columns(
        {"edge": F.when(F.col("event_type") != "error", F.floor("value").cast("double"))}
    )
    filled = seq.near(
        lambda w: {"filled": F.coalesce(F.col("edge"), F.avg("edge").over(w.rowsBetween(-3, after)))},
        before=3, after=after,
    )
    return filled.rows().select("record_id", "event_id", "edge", _r(F.col("filled"), "filled"))


def neighbour_fill_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_fill(spark, sf_dir, after=3)


def neighbour_fill_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_fill(spark, sf_dir, after=0)


_EDGE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _interval_columns() -> dict:
    return {
        name: I.interval_ms(F.col(on), F.col(off), T.NOMINAL_FS, lo, hi)
        for name, (on, off, lo, hi) in I.INTERVALS.items()
    }


def intervals_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.edges(spark, sf_dir)
    return e.select(*_EDGE_KEY, *[_r(c, n) for n, c in _interval_columns().items()])


def interval_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ungated intervals of each kind break their limits."""
    e = T.edges(spark, sf_dir)
    raw = {n: (F.col(off) - F.col(on)) * 4.0 for n, (on, off, _, _) in I.INTERVALS.items()}
    raw["RR_interval_ms"] = F.col("rr_raw")
    return e.agg(*[F.count_if(~I.plausible(n, c)).alias(n) for n, c in raw.items()])


def qtc_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.edges(spark, sf_dir)
    on, off, lo, hi = I.INTERVALS["QT_interval_ms"]
    qt = I.interval_ms(F.col(on), F.col(off), T.NOMINAL_FS, lo, hi)
    rr = F.when(F.col("rr_raw").between(300, 1800), F.col("rr_raw"))
    return e.select(*_EDGE_KEY, *[_r(c, n) for n, c in I.qtc_all(qt, rr).items()])


def _order_positions() -> dict:
    return {
        "P": F.col("P_le_idx"), "Q": F.col("Q_le_idx") - 40, "R": F.col("P_ri_idx") + 20,
        "S": F.col("S_ri_idx") - 20, "T": F.col("T_le_idx"),
    }


def temporal_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.edges(spark, sf_dir)
    bad = I.order_violations(_order_positions())
    any_bad = bad["P"] | bad["Q"] | bad["R"] | bad["S"]
    return e.select(*_EDGE_KEY, (~any_bad).alias("in_order"), *[c.alias(f"bad_{w}") for w, c in bad.items()])


def order_nulling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier wave of each bad pair is voided, except R; when R alone is
    at fault the four others are."""
    e = T.edges(spark, sf_dir)
    at = _order_positions()
    bad = I.order_violations(at)
    only_r = bad["R"] & ~bad["P"] & ~bad["Q"] & ~bad["S"]
    keep = {w: F.when(~(only_r | bad.get(w, F.lit(False))), at[w]) for w in ("P", "Q", "S", "T")}
    keep["R"] = at["R"]
    return e.select(*_EDGE_KEY, *[keep[w].alias(f"{w}_idx") for w in I.WAVES])


def _line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default variability features of every line, made of its edges."""
    e = T.edges(spark, sf_dir)
    cols = _interval_columns()
    rr = F.when(F.col("rr_raw").between(300, 1800), F.col("rr_raw"))
    qtc = I.qtc_all(cols["QT_interval_ms"], rr)
    width = {w: F.col(off) - F.col(on) for w, on, off in (
        ("P", "P_le_idx", "P_ri_idx"), ("R", "Q_le_idx", "S_ri_idx"), ("T", "T_le_idx", "T_ri_idx"))}
    made = {
        "RR_interval_ms": F.col("rr_raw"),
        **{n: cols[n] for n in ("QT_interval_ms", "QRS_interval_ms", "PR_interval_ms", "ST_segment_ms")},
        **{n: qtc[n] for n in ("QTc_Bazett_ms", "QTc_Fridericia_ms")},
        "R_gauss_height": F.col("rr_raw") / 1000, "P_gauss_height": width["P"] / 10, "T_gauss_height": width["T"] / 20,
        **{f"{w}_duration_ms": x * 4.0 for w, x in width.items()},
    }
    return e.select(F.col("l_suppkey").alias("record_id"), *[made[n].alias(n) for n in V.DEFAULT_FEATURES])


def variability_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = _line_features(spark, sf_dir)
    names = [c for c in feats.columns if c != "record_id"]
    out = V.variability(feats, ["record_id"], names)
    return out.select("record_id", "feature", *[_r(F.col(s), s) for s in V.STATS])


def variability_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.variability_wide(_line_features(spark, sf_dir), ["record_id"])
    return wide.select("record_id", *[_r(F.col(c), c) for c in wide.columns if c != "record_id"])


def subject_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer spending and timing summaries joined to the subject table."""
    orders = T.read(spark, sf_dir, "orders")
    feats = orders.select(
        F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("QT_interval_ms"),
        (F.col("o_totalprice") + F.col("o_orderkey") % 7).alias("RR_interval_ms"),
        F.col("o_orderkey").cast("double").alias("R_center_idx"),
    )
    names = [c for c in feats.columns if c != "subject"]
    agg = V.subject_aggregates(feats, ["subject"], names)
    subjects = T.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("age"), F.col("c_mktsegment").alias("sex")
    )
    out = agg.join(subjects, "subject")
    plain = {"subject", "n_cycles", "age", "sex"}
    return out.select(*[c if c in plain or c.endswith("_count") else _r(F.col(c), c) for c in out.columns])


def config_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per configuration (supplier nation): mean and total of the measures, and
    which configuration ranks first on each."""
    li = T.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    sup = T.read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    per = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("config"))
        .agg(
            F.avg("l_quantity").alias("mean_rate"),
            F.sum("l_quantity").alias("total_detected"),
            F.avg("l_discount").alias("mean_ratio"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    best = per.agg(
        F.max_by("config", F.struct("total_detected", "config")).alias("best"),
    )
    # one row joined by key against a handful of configurations
    marked = per.join(best.select(F.col("best").alias("config"), F.lit(True).alias("is_best")), "config", "left")
    return marked.select(
        "config", _r(F.col("mean_rate"), "mean_rate"), _r(F.col("total_detected"), "total_detected"),
        _r(F.col("mean_ratio"), "mean_ratio"), "n", F.coalesce("is_best", F.lit(False)).alias("is_best"),
    )


def detection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P detection rate, mean PR in the 80-300 ms range, share in that range."""
    cols = _interval_columns()
    e = T.edges(spark, sf_dir).select(
        F.col("l_suppkey").alias("record_id"), "P_le_idx", cols["PR_interval_ms"].alias("pr")
    )
    ok = F.col("pr").between(80, 300)
    return e.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.count("P_le_idx").alias("p_detected"),
        _r(F.count("P_le_idx") * 100.0 / F.count(F.lit(1)), "detection_rate"),
        _r(F.avg(F.when(ok, F.col("pr"))), "mean_pr_interval_ms"),
        _r(F.coalesce(F.try_divide(F.count_if(ok) * 100.0, F.count("pr")), F.lit(0.0)), "valid_pr_ratio"),
    )


def _truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = T.rr_series(spark, sf_dir).rows().select("record_id", "event_id", "t_us", "event_type")
    kind = lambda k: events.where(F.col("event_type") == k).drop("event_type")
    return kind("view"), kind("click")


def tolerance_semi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _truth_and_found(spark, sf_dir)
    out = M.hits(truth, found, ["record_id"], "t_us", TOLERANCE_US)
    return out.where("hit").select("record_id", "event_id", "t_us")


def detection_rate_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of annotations hit per record, with the count of detections."""
    truth, found = _truth_and_found(spark, sf_dir)
    hit = M.hits(truth, found, ["record_id"], "t_us", TOLERANCE_US)
    per_truth = hit.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if("hit").alias("n_hit"))
    per_found = found.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_found"))
    both = per_truth.join(per_found, "record_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return both.select(
        "record_id", "n_truth", "n_hit", "n_found",
        _r(F.col("n_hit") * 100.0 / F.col("n_truth"), "detection_rate"),
        _r(F.coalesce(F.try_divide(F.col("n_hit") * 100.0, F.col("n_found")), F.lit(0.0)), "precision"),
    )


def across_subject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, extremes, population deviation and count at 80 % or more."""
    rates = written(detection_rate_by_record(spark, sf_dir))
    med = percentiles(rates, [], "detection_rate", {"median_rate": 0.5})
    out = rates.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.avg("detection_rate").alias("mean_rate"),
        F.min("detection_rate").alias("min_rate"), F.max("detection_rate").alias("max_rate"),
        F.stddev_pop("detection_rate").alias("std_rate"),
        F.count_if(F.col("detection_rate") >= 80).alias("n_above_80"),
    ).join(med, F.lit(True))  # one row each
    return out.select("n_subjects", "n_above_80", *[
        _r(F.col(c), c) for c in ("mean_rate", "median_rate", "min_rate", "max_rate", "std_rate")])


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _truth_and_found(spark, sf_dir)
    return M.match_one_to_one(
        truth, found, ["record_id"], "t_us", TOLERANCE_US, slice_width=24 * 3600 * 1_000_000)


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one scores per record with timing errors in minutes."""
    truth, found = _truth_and_found(spark, sf_dir)
    pairs = M.match_one_to_one(
        truth, found, ["record_id"], "t_us", TOLERANCE_US, slice_width=24 * 3600 * 1_000_000
    ).withColumn("minutes", F.col("distance") / 60e6)
    counts = (
        truth.groupBy("record_id").agg(F.count_distinct("t_us").alias("n_truth"))
        .join(found.groupBy("record_id").agg(F.count_distinct("t_us").alias("n_found")), "record_id", "full")
        .join(pairs.groupBy("record_id").agg(
            F.count(F.lit(1)).alias("n_matched"), F.avg("minutes").alias("mae")), "record_id", "left")
        .na.fill(0, ["n_truth", "n_found", "n_matched"])
    )
    med = percentiles(pairs, ["record_id"], "minutes", {"median_ae": 0.5})
    s = M.scores(F.col("n_truth"), F.col("n_found"), F.col("n_matched"))
    return counts.join(med, "record_id", "left").select(
        "record_id",
        *[_r(s[c], c) for c in ("precision", "recall", "f1")],
        *[s[c].alias(c) for c in ("true_positives", "false_positives", "false_negatives")],
        _r(F.col("mae"), "mae"), _r(F.col("median_ae"), "median_ae"),
    )
