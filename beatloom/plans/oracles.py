"""DuckDB statements giving the expected rows of the registered queries."""

from __future__ import annotations

RR = """rr AS (SELECT user_id AS record_id, event_id, epoch_us(ts) AS t_us,
  300.0::DOUBLE + 10.0::DOUBLE * value AS rr_raw, event_type, value FROM events)"""
GATED = RR + """, g AS (SELECT *, CASE WHEN rr_raw BETWEEN 300 AND 1800 THEN rr_raw END AS rr_ms FROM rr)"""
W = "(PARTITION BY record_id ORDER BY t_us, event_id)"
CYC = "cyc AS (SELECT label AS record_id, vec_id AS cycle, CAST(embedding AS DOUBLE[]) AS y FROM embeddings)"
SMP = CYC + """, smp AS (SELECT record_id, cycle, CAST(generate_subscripts(y, 1) - 1 AS INT) AS i, unnest(y) AS v FROM cyc)"""
RPK = SMP + """, rp AS (SELECT record_id, cycle, arg_max(i, (abs(v), -i)) AS r, arg_max(v, (abs(v), -i)) AS h,
  64 AS n FROM smp GROUP BY ALL)"""
EDGES = """e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity) END AS P_le,
  floor(l_quantity) + 5 + 4 * l_linenumber AS P_ri,
  (70 + l_partkey % 40)::DOUBLE AS Q_le,
  (75 + l_partkey % 40 + l_suppkey % 30)::DOUBLE AS s0,
  CASE WHEN l_suppkey % 11 <> 0 THEN s0 END AS S_ri,
  s0 + floor(l_discount * 400) AS T_le,
  s0 + floor(l_discount * 400) + 10 + l_partkey % 61 AS t0,
  CASE WHEN l_linestatus = 'O' THEN t0 WHEN l_partkey % 5 <> 0 THEN t0 - 20 END AS T_ri,
  250.0::DOUBLE + l_extendedprice / 50.0::DOUBLE AS rr_raw FROM lineitem)"""
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LIMITS = (
    ("PR_interval_ms", "P_le", "Q_le", 50, 500), ("PR_segment_ms", "P_ri", "Q_le", 10, 400),
    ("QRS_interval_ms", "Q_le", "S_ri", 20, 300), ("ST_segment_ms", "S_ri", "T_le", 20, 500),
    ("ST_interval_ms", "S_ri", "T_ri", 5, 700), ("QT_interval_ms", "Q_le", "T_ri", 200, 750),
)


def _gate(on: str, off: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {off} - {on} >= 0 AND ({off} - {on}) * 4.0 BETWEEN {lo} AND {hi} THEN ({off} - {on}) * 4.0::DOUBLE END"


INTERVALS = {n: _gate(*rest) for n, *rest in LIMITS}
RAW_GAPS = ", ".join(
    f"count(*) FILTER (WHERE ({off} - {on}) * 4 NOT BETWEEN {lo} AND {hi}) AS {n}" for n, on, off, lo, hi in LIMITS)
ORDER = EDGES + """, o AS (SELECT *, P_le AS p, Q_le - 40 AS q, P_ri + 20 AS r, S_ri - 20 AS s, T_le AS t FROM e),
b AS (SELECT *, coalesce(p >= coalesce(q, r, s, t), FALSE) AS bp, coalesce(q >= coalesce(r, s, t), FALSE) AS bq,
  coalesce(r >= coalesce(s, t), FALSE) AS br, coalesce(s >= t, FALSE) AS bs FROM o)"""
HRV = GATED + f""", v AS (SELECT * FROM g WHERE rr_ms IS NOT NULL),
d AS (SELECT *, rr_ms - lag(rr_ms) OVER {W} AS step FROM v),
h AS (SELECT record_id, count(*) AS n_rr, avg(60000.0::DOUBLE / rr_ms) AS hr, stddev_samp(rr_ms) AS sdnn,
  sqrt(avg(step * step)) AS rmssd, count(*) FILTER (WHERE abs(step) > 50) AS nn50, count(step) AS pairs
  FROM d GROUP BY record_id)
SELECT record_id, n_rr, round(hr, 6) AS average_heart_rate, round(sdnn, 6) AS sdnn, round(rmssd, 6) AS rmssd,
  nn50, round(nn50 * 100.0::DOUBLE / pairs, 6) AS pnn50, round(rmssd / sqrt(2.0), 6) AS sd1,
  CASE WHEN 2 * sdnn * sdnn - rmssd * rmssd / 2 >= 0 THEN round(sqrt(2 * sdnn * sdnn - rmssd * rmssd / 2), 6) END AS sd2
FROM h WHERE n_rr >= """
FILL = RR + """, s AS (SELECT *, CASE WHEN event_type <> 'error' THEN floor(value) END AS edge FROM rr)
SELECT record_id, event_id, edge, round(coalesce(edge, avg(edge) OVER (PARTITION BY record_id ORDER BY t_us, event_id
  ROWS BETWEEN 3 PRECEDING AND {after})), 6) AS filled FROM s"""
_RR = "CASE WHEN rr_raw BETWEEN 300 AND 1800 THEN rr_raw END / 1000"
FEATURES = {
    "QT_interval_ms": INTERVALS["QT_interval_ms"], "QRS_interval_ms": INTERVALS["QRS_interval_ms"],
    "PR_interval_ms": INTERVALS["PR_interval_ms"], "RR_interval_ms": "rr_raw",
    "QTc_Bazett_ms": f"({INTERVALS['QT_interval_ms']}) / sqrt({_RR})",
    "QTc_Fridericia_ms": f"({INTERVALS['QT_interval_ms']}) / pow({_RR}, 1.0::DOUBLE / 3)",
    "R_gauss_height": "rr_raw / 1000", "P_gauss_height": "(P_ri - P_le) / 10.0::DOUBLE", "T_gauss_height": "(T_ri - T_le) / 20.0::DOUBLE",
    "R_duration_ms": "(S_ri - Q_le) * 4.0::DOUBLE", "P_duration_ms": "(P_ri - P_le) * 4.0::DOUBLE", "T_duration_ms": "(T_ri - T_le) * 4.0::DOUBLE",
    "ST_segment_ms": INTERVALS["ST_segment_ms"],
}
FEATS = EDGES + f""", f AS (SELECT l_suppkey AS record_id, {", ".join(f"({x})::DOUBLE AS {n}" for n, x in FEATURES.items())} FROM e),
lg AS (SELECT record_id, feature, value FROM f UNPIVOT (value FOR feature IN ({", ".join(FEATURES)}))),
st AS (SELECT record_id, feature, count(*) AS n, stddev_samp(value) AS sd, avg(value) AS m,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, 1.4826::DOUBLE * mad(value) AS md,
  max(value) - min(value) AS rg FROM lg GROUP BY ALL),
vs AS (SELECT record_id, feature, CASE WHEN n >= 2 THEN round(sd, 6) END AS std,
  CASE WHEN n >= 2 AND abs(m) > 1e-6 THEN round(sd / abs(m), 6) END AS cv,
  CASE WHEN n >= 2 THEN round(iqr, 6) END AS iqr, CASE WHEN n >= 2 THEN round(md, 6) END AS mad,
  CASE WHEN n >= 2 THEN round(rg, 6) END AS "range" FROM st)"""
WIDE = ", ".join(
    f"max(CASE WHEN feature = '{f}' THEN \"{s}\" END) AS {f}_{s}"
    for f in FEATURES for s in ("std", "cv", "iqr", "mad", "range"))
TOL = 30 * 60 * 1_000_000
MATCH = RR + f""", t AS (SELECT * FROM rr WHERE event_type = 'view'), d AS (SELECT * FROM rr WHERE event_type = 'click'),
hit AS (SELECT t.*, EXISTS (SELECT 1 FROM d WHERE d.record_id = t.record_id
  AND d.t_us BETWEEN t.t_us - {TOL} AND t.t_us + {TOL}) AS hit FROM t)"""
RATES = MATCH + """, pt AS (SELECT record_id, count(*) AS n_truth, count(*) FILTER (WHERE hit) AS n_hit FROM hit GROUP BY 1),
pf AS (SELECT record_id, count(*) AS n_found FROM d GROUP BY 1),
rates AS (SELECT pt.record_id, n_truth, n_hit, coalesce(n_found, 0) AS n_found,
  round(n_hit * 100.0::DOUBLE / n_truth, 6) AS detection_rate,
  coalesce(round(n_hit * 100.0::DOUBLE / nullif(n_found, 0), 6), 0) AS "precision"
  FROM pt LEFT JOIN pf USING (record_id))"""
# closest-first greedy pairing, one pair of a record after another
GREEDY = MATCH + f""", tt AS (SELECT DISTINCT record_id, t_us AS a FROM t), dd AS (SELECT DISTINCT record_id, t_us AS b FROM d),
pairs AS (SELECT record_id, a, b, row_number() OVER (PARTITION BY record_id ORDER BY abs(a - b), a, b) AS k
  FROM tt JOIN dd USING (record_id) WHERE b BETWEEN a - {TOL} AND a + {TOL}),
walk AS (SELECT DISTINCT record_id, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM pairs
  UNION ALL SELECT p.record_id, p.k,
    CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END,
    CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END
  FROM walk w JOIN pairs p ON p.record_id = w.record_id AND p.k = w.k + 1),
fin AS (SELECT record_id, arg_max(ua, k) AS ua, arg_max(ub, k) AS ub FROM walk GROUP BY 1),
m AS (SELECT record_id, unnest(ua) AS truth_at, unnest(ub) AS found_at FROM fin)"""
AGG_STATS = ("mean", "std", "median", "min", "max", "count")


def _subject(f: str, expr: str) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "median": "median", "min": "min", "max": "max"}
    return ", ".join([f"round({fn[s]}({expr}), 6) AS {f}_{s}" for s in AGG_STATS[:-1]] + [f"count({expr}) AS {f}_count"])


DIFF = SMP + """, df AS (SELECT a.record_id, a.cycle, a.i, b.v - a.v AS d FROM smp a
  JOIN smp b ON b.record_id = a.record_id AND b.cycle = a.cycle AND b.i = a.i + 1)"""
SEG = RPK + """, sg AS (SELECT *, greatest(r - 10, 0) AS le, least(r + 10, n - 1) AS ri FROM rp)"""
QS = RPK + """, q AS (SELECT rp.record_id, rp.cycle, arg_min(s.i, (s.v, s.i)) AS q, min(s.v) AS qv FROM rp
  JOIN smp s USING (record_id, cycle) WHERE s.i >= greatest(r - 38, 0) AND s.i < r GROUP BY ALL),
sx AS (SELECT rp.record_id, rp.cycle, arg_min(s.i, (s.v, s.i)) AS s, min(s.v) AS sv FROM rp
  JOIN smp s USING (record_id, cycle) WHERE s.i > r AND s.i < r + 38 GROUP BY ALL),
qs AS (SELECT rp.*, q.q, q.qv, sx.s, sx.sv FROM rp LEFT JOIN q USING (record_id, cycle) LEFT JOIN sx USING (record_id, cycle))"""
EDGE = RPK + """, ed AS (SELECT rp.record_id, rp.cycle, any_value(r) AS r,
  coalesce(max(s.i) FILTER (WHERE s.i < r AND s.v * sign(h) <= abs(h) / 2), 0) AS lft,
  coalesce(min(s.i) FILTER (WHERE s.i > r AND s.v * sign(h) <= abs(h) / 2), 63) AS rgt
  FROM rp JOIN smp s USING (record_id, cycle) GROUP BY rp.record_id, rp.cycle)"""
TPL = SMP + ", tp AS (SELECT record_id, i, avg(v) AS m FROM smp GROUP BY ALL)"

NOISE = """nz AS (SELECT record_id, cycle, avg(rg) AS noise FROM (SELECT record_id, cycle, i // 5 AS blk,
  max(v) - min(v) AS rg FROM smp GROUP BY ALL) GROUP BY ALL)"""


GRAD = RPK + """, g AS (SELECT record_id, cycle, i, (lead(v, 1, v) OVER w - lag(v, 1, v) OVER w)
  / CASE WHEN i IN (0, 63) THEN 1.0::DOUBLE ELSE 2.0 END AS d FROM smp WINDOW w AS (PARTITION BY cycle ORDER BY i))"""
# R positions at 250 Hz from running sums in tenths of a millisecond
TRUTH = GATED + """, calm AS (SELECT record_id, t_us, event_id,
  round_even((600 + (rr_ms - 300) * 4.0::DOUBLE / 15) * 10, 0)::BIGINT AS d FROM g WHERE rr_ms IS NOT NULL),
run AS (SELECT record_id, sum(d) OVER (PARTITION BY record_id ORDER BY t_us, event_id) AS t FROM calm),
truth AS (SELECT record_id::VARCHAR AS record_id, floor(t * 250.0::DOUBLE / 10000.0)::BIGINT AS sample FROM run)"""


def _st() -> str:
    w = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5)}
    dot = lambda ws, at: "(" + " + ".join(f"{float(x)} * seg[{at} + {k}]" for k, x in enumerate(ws)) + ") / 35.0"
    return CYC + f""", c AS (SELECT *, (cycle % 13 + 30)::INT AS s_ri, (cycle % 13 + 33 + cycle % 23)::INT AS t_le,
  CASE WHEN cycle % 4 <> 0 THEN (cycle % 9 + 5)::INT END AS p_ri, (cycle % 7 + 18)::INT AS q_le FROM cyc),
a AS (SELECT *, y[s_ri + 1 : t_le + 1] AS seg, t_le - s_ri + 1 AS m,
  coalesce(CASE WHEN p_ri < q_le THEN list_median(y[p_ri + 1 : q_le + 1]) END, list_median(y[s_ri - 11 : s_ri])) AS base FROM c),
u AS (SELECT record_id, cycle, base, m, t_le, unnest(range(m)) AS j, seg FROM a),
sm AS (SELECT record_id, cycle, base, m, t_le, j, CASE WHEN m < 5 THEN seg[j + 1]
  WHEN j = 0 THEN {dot(w[0], '1')} WHEN j = 1 THEN {dot(w[1], '1')}
  WHEN j = m - 1 THEN {dot(w[0][::-1], 'm - 4')} WHEN j = m - 2 THEN {dot(w[1][::-1], 'm - 4')}
  ELSE {dot((-3, 12, 17, 12, -3), 'j - 1')} END AS v FROM u)
SELECT record_id, cycle, round(max(v) FILTER (WHERE j = least(10, m - 1) AND t_le < 64), 6) AS ST_elevation_mv,
  round(regr_slope(v, j) FILTER (WHERE t_le < 64) * 250, 6) AS ST_slope_mv_per_s,
  round(max(v) FILTER (WHERE j = least(10, m - 1) AND t_le < 64) - any_value(base), 6) AS ST_deviation_mv
FROM sm GROUP BY record_id, cycle"""


def _snr(snr: str, flip: bool) -> str:
    ramp = f"({snr} - 3) / 7 * 0.8"
    mid = f"1.5 - {ramp}" if flip else f"0.7 + {ramp}"
    return f"abs(h) * greatest(0.05, least(0.40, 0.15 * CASE WHEN {snr} < 3 THEN 1.5 WHEN {snr} < 10 THEN {mid} ELSE 0.7 END))"


SQL: dict[str, str] = {
    "rr_intervals_gated": f"WITH {RR}, x AS (SELECT record_id, event_id, (t_us - lag(t_us) OVER {W}) * (1000.0::DOUBLE / 1000000.0) AS ms FROM rr) "
        "SELECT record_id, event_id, CASE WHEN ms > 0 AND ms BETWEEN 300 AND 40000000 THEN round(ms, 3) END AS rr_interval_ms FROM x",
    "rr_last_valid_prev": f"WITH {RR}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN t_us END AS r_idx FROM rr), "
        "y AS (SELECT *, last_value(r_idx IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_r_idx FROM x) "
        "SELECT record_id, event_id, prev_r_idx, r_idx - prev_r_idx AS rr_us FROM y",
    "pp_lag": f"WITH {RR}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN t_us END AS p FROM rr) SELECT record_id, event_id, p - lag(p) OVER {W} AS pp_us FROM x",
    "hrv_by_record": f"WITH {HRV} 2",
    "hrv_min60": f"WITH {HRV} 60",
    "rr_median_band_filter": f"WITH {GATED}, m AS (SELECT record_id, median(rr_ms) AS med FROM g GROUP BY 1) "
        "SELECT record_id, event_id, round(rr_ms, 6) AS rr_ms, round(med, 6) AS median_rr FROM g JOIN m USING (record_id) WHERE rr_ms BETWEEN med * 0.92::DOUBLE AND med * 1.16::DOUBLE",
    "poincare_pairs": f"WITH {GATED}, p AS (SELECT record_id, event_id, round(rr_ms, 6) AS rr_n, round(lead(rr_ms) OVER {W}, 6) AS rr_next FROM g WHERE rr_ms IS NOT NULL) SELECT * FROM p WHERE rr_next IS NOT NULL",
    "neighbour_fill_centered": "WITH " + FILL.format(after="3 FOLLOWING"),
    "neighbour_fill_trailing": "WITH " + FILL.format(after="CURRENT ROW"),
    "intervals_limits": f"WITH {EDGES} SELECT {KEY}, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in INTERVALS.items()) + " FROM e",
    "interval_plausibility": f"WITH {EDGES} SELECT {RAW_GAPS}, count(*) FILTER (WHERE rr_raw NOT BETWEEN 300 AND 1800) AS RR_interval_ms FROM e",
    "qtc_three": f"WITH {EDGES}, x AS (SELECT *, {INTERVALS['QT_interval_ms']} AS qt, CASE WHEN rr_raw BETWEEN 300 AND 1800 THEN rr_raw END AS rr FROM e) "
        f"SELECT {KEY}, round(qt / sqrt(rr / 1000), 6) AS QTc_Bazett_ms, round(qt / pow(rr / 1000, 1.0::DOUBLE / 3), 6) AS QTc_Fridericia_ms, round(qt + 0.154::DOUBLE * (1000 - rr), 6) AS QTc_Framingham_ms FROM x",
    "temporal_order_check": f"WITH {ORDER} SELECT {KEY}, NOT (bp OR bq OR br OR bs) AS in_order, bp AS bad_P, bq AS bad_Q, br AS bad_R, bs AS bad_S FROM b",
    "order_nulling": f"WITH {ORDER}, n AS (SELECT *, br AND NOT bp AND NOT bq AND NOT bs AS only_r FROM b) SELECT {KEY}, "
        "CASE WHEN NOT (only_r OR bp) THEN p END AS P_idx, CASE WHEN NOT (only_r OR bq) THEN q END AS Q_idx, r AS R_idx, "
        "CASE WHEN NOT (only_r OR bs) THEN s END AS S_idx, CASE WHEN NOT only_r THEN t END AS T_idx FROM n",
    "variability_long": f"WITH {FEATS} SELECT * FROM vs",
    "variability_wide": f"WITH {FEATS} SELECT record_id, {WIDE} FROM vs GROUP BY record_id",
    "subject_aggregates": "WITH a AS (SELECT o_custkey AS subject, count(*) AS n_cycles, "
        + _subject("QT_interval_ms", "o_totalprice") + ", " + _subject("RR_interval_ms", "o_totalprice + o_orderkey % 7")
        + " FROM orders GROUP BY 1) SELECT a.*, c_nationkey AS age, c_mktsegment AS sex FROM a JOIN customer ON c_custkey = subject",
    "config_compare": "WITH p AS (SELECT s_nationkey AS config, avg(l_quantity) AS mr, sum(l_quantity) AS td, avg(l_discount) AS mp, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) "
        "SELECT config, round(mr, 6) AS mean_rate, round(td, 6) AS total_detected, round(mp, 6) AS mean_ratio, n, config = (SELECT arg_max(config, (td, config)) FROM p) AS is_best FROM p",
    "detection_stats": f"WITH {EDGES}, x AS (SELECT l_suppkey AS record_id, P_le, {INTERVALS['PR_interval_ms']} AS pr FROM e) "
        "SELECT record_id, count(*) AS total_cycles, count(P_le) AS p_detected, round(count(P_le) * 100.0::DOUBLE / count(*), 6) AS detection_rate, "
        "round(avg(pr) FILTER (WHERE pr BETWEEN 80 AND 300), 6) AS mean_pr_interval_ms, "
        "round(coalesce(count(*) FILTER (WHERE pr BETWEEN 80 AND 300) * 100.0::DOUBLE / nullif(count(pr), 0), 0), 6) AS valid_pr_ratio FROM x GROUP BY 1",
    "tolerance_semi_match": f"WITH {MATCH} SELECT record_id, event_id, t_us FROM hit WHERE hit",
    "detection_rate_by_record": f"WITH {RATES} SELECT * FROM rates",
    "across_subject_stats": f"WITH {RATES} SELECT count(*) AS n_subjects, count(*) FILTER (WHERE detection_rate >= 80) AS n_above_80, round(avg(detection_rate), 6) AS mean_rate, "
        "round(median(detection_rate), 6) AS median_rate, round(min(detection_rate), 6) AS min_rate, round(max(detection_rate), 6) AS max_rate, round(stddev_pop(detection_rate), 6) AS std_rate FROM rates",
    "cycle_chord_detrend": f"WITH {CYC}, u AS (SELECT record_id, cycle, y, unnest(range(len(y)))::INT AS i FROM cyc) "
        "SELECT record_id, cycle, i, round(y[i + 1] - (y[1] + i * ((y[64] - y[1]) / 63.0::DOUBLE)), 6) AS y_detrended FROM u",
    "cycle_trend": f"WITH {CYC} SELECT record_id, cycle, round((y[64] - y[1]) / 63.0::DOUBLE, 8) AS cycle_trend FROM cyc",
    "cycle_linear_detrend": f"WITH {SMP}, f AS (SELECT record_id, cycle, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM smp GROUP BY ALL) "
        "SELECT record_id, cycle, i, round(v - a - b * i, 6) AS y_detrended FROM smp JOIN f USING (record_id, cycle)",
    "cycle_argmax_abs": f"WITH {RPK} SELECT rp.record_id, rp.cycle, r AS argmax_idx, CASE WHEN abs(r - 32) > 12 AND abs(s.v) >= 0.8::DOUBLE * abs(h) THEN 32 ELSE r END AS r_idx FROM rp JOIN smp s ON s.record_id = rp.record_id AND s.cycle = rp.cycle AND s.i = 32",
    "trough_before_r": f"WITH {QS} SELECT record_id, cycle, q AS q_idx, round(qv, 6) AS q_mv FROM qs",
    "trough_after_r": f"WITH {QS} SELECT record_id, cycle, s AS s_idx, round(sv, 6) AS s_mv FROM qs",
    "first_diff_slopes": f"WITH {SEG}, df AS (SELECT record_id, cycle, i, lead(v) OVER (PARTITION BY cycle ORDER BY i) - v AS d FROM smp), "
        "x AS (SELECT sg.record_id, sg.cycle, max(d) FILTER (WHERE i >= le AND i < r) * 250 AS up, min(d) FILTER (WHERE i >= r AND i < ri) * 250 AS dn FROM sg JOIN df USING (record_id, cycle) GROUP BY ALL) "
        "SELECT record_id, cycle, round(up, 6) AS max_upslope_mv_per_s, round(dn, 6) AS max_downslope_mv_per_s, round(abs(up) / nullif(abs(dn), 0), 6) AS slope_asymmetry FROM x",
    "wave_durations": f"WITH {SEG} SELECT record_id, cycle, round((ri - le) * 4.0::DOUBLE, 6) AS duration_ms, round((r - le) * 4.0::DOUBLE, 6) AS rise_ms, round((ri - r) * 4.0::DOUBLE, 6) AS decay_ms, "
        "round((r - le) * 4.0::DOUBLE / nullif((ri - le) * 4.0::DOUBLE, 0), 6) AS rdsm FROM sg",
    "voltage_integral": f"WITH {SEG}, z AS (SELECT record_id, cycle, i, (v + lead(v) OVER (PARTITION BY cycle ORDER BY i)) / 2 AS a FROM smp) "
        "SELECT sg.record_id, sg.cycle, round(sum(a) / 250, 6) AS cycle_integral, round(sum(a) FILTER (WHERE i >= le AND i < ri) / 250 * 1e6, 3) AS r_voltage_integral_uv_ms FROM sg JOIN z USING (record_id, cycle) GROUP BY ALL",
    "sharpness_p95_p2p": f"WITH {DIFF}, a AS (SELECT record_id, cycle, quantile_cont(abs(d), 0.95) AS sl FROM df GROUP BY ALL), b AS (SELECT record_id, cycle, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS amp FROM smp GROUP BY ALL) "
        "SELECT record_id, cycle, CASE WHEN amp >= 1e-6 THEN round(sl * 250 / amp, 6) END AS sharpness FROM a JOIN b USING (record_id, cycle)",
    "sharpness_variants": f"WITH {DIFF}, a AS (SELECT record_id, cycle, median(abs(d)) AS md, avg(abs(d)) AS mn FROM df GROUP BY ALL), b AS (SELECT record_id, cycle, 1.4826::DOUBLE * mad(v) AS mad, sqrt(avg(v * v)) AS rms FROM smp GROUP BY ALL) "
        "SELECT record_id, cycle, round(md * 250 / mad, 6) AS median_mad, round(mn * 250 / rms, 6) AS mean_rms FROM a JOIN b USING (record_id, cycle)",
    "cycle_template": f"WITH {TPL} SELECT record_id, i, round(m, 6) AS template FROM tp",
    "r2_rmse_vs_template": f"WITH {TPL} SELECT record_id, cycle, round(pow(corr(v, m), 2), 6) AS r_squared, round(sqrt(avg((v - m) * (v - m))), 6) AS rmse FROM smp JOIN tp USING (record_id, i) GROUP BY ALL",
    "template_corr_var_filter": f"""WITH {RPK}, fl AS (SELECT record_id, cycle, CASE WHEN min(v) < -max(v) THEN -1.0 ELSE 1.0 END AS sg FROM smp GROUP BY ALL),
        u AS (SELECT s.record_id, s.cycle, s.i, s.v, s.v * sg AS uv, h < 0 AS inv FROM smp s JOIN fl USING (record_id, cycle) JOIN rp USING (record_id, cycle)),
        whole AS (SELECT record_id, i, avg(uv) AS m FROM u GROUP BY ALL), side AS (SELECT record_id, inv, i, avg(v) AS m FROM u GROUP BY ALL),
        mx AS (SELECT record_id, count(DISTINCT inv) > 1 AS mixed, var_pop(v) AS sv FROM u GROUP BY ALL),
        c AS (SELECT u.record_id, u.cycle, corr(uv, CASE WHEN mixed THEN side.m ELSE whole.m END) AS c, var_pop(u.v) AS var, any_value(sv) AS sv, any_value(mixed) AS mixed
          FROM u JOIN mx USING (record_id) JOIN whole ON whole.record_id = u.record_id AND whole.i = u.i JOIN side ON side.record_id = u.record_id AND side.inv = u.inv AND side.i = u.i GROUP BY ALL)
        SELECT record_id, cycle, round(c, 6) AS corr, round(var, 8) AS var, c >= CASE WHEN mixed THEN 0.55 ELSE 0.70 END AND var <= sv AS kept FROM c""",
    "fwhm_edges": f"WITH {EDGE}, z AS (SELECT *, greatest((rgt - lft) / 2.3548::DOUBLE, 1.0) AS sigma FROM ed) SELECT record_id, cycle, lft AS left_idx, rgt AS right_idx, round(sigma, 6) AS sigma, "
        "greatest(0, least(63, round_even(r - sigma * 2.3548::DOUBLE / 2, 0)::INT)) AS fwhm_le_idx, greatest(0, least(63, round_even(r + sigma * 2.3548::DOUBLE / 2, 0)::INT)) AS fwhm_ri_idx FROM z",
    "key_point_voltages": f"WITH {SEG} SELECT sg.record_id, sg.cycle, "
        + ", ".join(f"round(max(v) FILTER (WHERE i = {c}), 6) AS {n}_voltage, any_value(sg.cycle * 64 + {c}) AS global_{n}_idx, round(any_value(sg.cycle * 64 + {c}) / 250.0::DOUBLE * 1000, 3) AS {n}_ms" for n, c in (("center", "r"), ("le", "le"), ("ri", "ri")))
        + " FROM sg JOIN smp USING (record_id, cycle) GROUP BY sg.record_id, sg.cycle",
    "moving_average_energy": f"WITH {SMP}, g AS (SELECT record_id, cycle, i, (lead(v, 1, v) OVER w - lag(v, 1, v) OVER w) / CASE WHEN i IN (0, 63) THEN 1.0::DOUBLE ELSE 2.0 END AS d FROM smp WINDOW w AS (PARTITION BY cycle ORDER BY i)) "
        "SELECT record_id, cycle, i, round(sum(d * d) OVER (PARTITION BY cycle ORDER BY i ROWS BETWEEN 19 PRECEDING AND 18 FOLLOWING) / 38, 8) AS energy FROM g",
    "local_maxima": f"WITH {SMP}, w AS (SELECT *, lag(v) OVER (PARTITION BY cycle ORDER BY i) AS a, lead(v) OVER (PARTITION BY cycle ORDER BY i) AS b FROM smp) SELECT record_id, cycle, i FROM w WHERE v > a AND v > b",
    "derivative_turning_points": f"WITH {SMP}, w AS (SELECT *, lag(v) OVER (PARTITION BY cycle ORDER BY i) AS a, lead(v) OVER (PARTITION BY cycle ORDER BY i) AS b FROM smp) "
        "SELECT record_id, cycle, count(*)::INT AS n_points, arg_max(i, (abs(v), -i)) AS picked_idx FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND sign(v - a) <> sign(b - v) GROUP BY ALL",
    "zero_crossings": f"WITH {SMP}, w AS (SELECT *, lead(v) OVER (PARTITION BY cycle ORDER BY i) AS b FROM smp) SELECT DISTINCT record_id, cycle, CASE WHEN abs(v) < abs(b) THEN i ELSE i + 1 END AS i FROM w WHERE v * b <= 0",
    "parabolic_refine": f"WITH {RPK}, x AS (SELECT rp.*, a.v AS a, b.v AS b FROM rp LEFT JOIN smp a ON a.cycle = rp.cycle AND a.i = r - 1 LEFT JOIN smp b ON b.cycle = rp.cycle AND b.i = r + 1), "
        "y AS (SELECT *, (a - b) / nullif(a - 2 * h + b, 0) AS o FROM x) SELECT record_id, cycle, r, CASE WHEN o IS NULL THEN 0.5 ELSE round(greatest(-0.5, least(0.5, o)), 6) END AS offset_doubled, CASE WHEN o IS NULL THEN 0.5 ELSE round(greatest(-0.5, least(0.5, o / 2)), 6) END AS offset_exact FROM y",
    "mad_noise_gate": f"WITH {SMP}, m AS (SELECT record_id, cycle, arg_max(i, (v, -i)) AS r, max(v) AS h FROM smp GROUP BY ALL), o AS (SELECT record_id, cycle, any_value(r) AS r, any_value(h) AS h, 1.4826::DOUBLE * mad(v) AS md FROM m JOIN smp USING (record_id, cycle) WHERE abs(i - r) > 5 GROUP BY ALL) "
        "SELECT record_id, cycle, r, round(md, 6) AS mad, md <= 1e-9 OR abs(h) >= 2 * md AS keep FROM o",
    "rolling_deviation_gate": f"WITH {SMP}, a AS (SELECT *, abs(v - sum(v) OVER (PARTITION BY cycle ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7) AS d FROM smp), b AS (SELECT *, 1.4826::DOUBLE * sum(d) OVER (PARTITION BY cycle ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS m FROM a) "
        "SELECT record_id, cycle, round(median(m), 6) AS rolling_dev FROM b GROUP BY ALL",
    "block_range_noise": f"WITH {SMP}, {NOISE} SELECT record_id, cycle, round(noise, 6) AS noise FROM nz",
    "amp_ratio_gate": f"WITH {QS} SELECT record_id, cycle, coalesce(abs(qv) >= greatest(abs(h) * 0.5, 0.001) AND qv < 0, FALSE) AS keep_q, coalesce(abs(sv) >= greatest(abs(h) * 0.5, 0.001) AND sv < 0, FALSE) AS keep_s, "
        "round(greatest(0.01::DOUBLE, abs(h) * CASE WHEN abs(h) >= 0.41 THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END), 8) AS min_height FROM qs",
    "pairwise_diffs": f"WITH {QS} SELECT record_id, cycle, round(h - sv, 6) AS r_minus_s, round(abs(h - qv), 6) AS abs_r_minus_q FROM qs",
    "t_search_window": f"WITH {QS}, x AS (SELECT *, greatest(r + 25, coalesce(s, r) + 5) AS t0 FROM qs) SELECT record_id, cycle, t0 AS t_start, least(64, greatest(least(r + 112, 64), t0 + 25)) AS t_stop FROM x",
    "st_features": "WITH " + _st(),
    "snr_adaptive_threshold": f"WITH {RPK}, {NOISE}, x AS (SELECT rp.*, abs(h) / noise AS snr FROM rp JOIN nz USING (record_id, cycle)) SELECT record_id, cycle, round({_snr('snr', False)}, 8) AS threshold, round({_snr('snr', True)}, 8) AS threshold_repaired FROM x",
    "epoch_windows": f"""WITH {RPK}, b AS (SELECT cycle // 16 AS record_id, (cycle % 16)::INT AS k, (cycle % 16) * 64 + r AS pos, r FROM rp),
        hw AS (SELECT record_id, round_even((max(pos) - min(pos)) / (count(*) - 1)::DOUBLE / 2, 0)::INT AS half, count(*) AS nb FROM b GROUP BY 1),
        near AS (SELECT cycle // 16 AS record_id, (cycle % 16) * 64 + i AS pos, v FROM smp),
        j AS (SELECT b.record_id, b.k, half, b.pos, count(*) AS n, sum(v) AS sum_y, arg_min(v, near.pos) AS first_y FROM b JOIN hw USING (record_id)
          JOIN near ON near.record_id = b.record_id AND near.pos >= b.pos - half AND near.pos < b.pos + half
            AND near.pos >= (b.k - 1) * 64 AND near.pos < (b.k + 2) * 64 WHERE half > 1 GROUP BY ALL)
        SELECT record_id, k, half, n::INT AS n, round(sum_y, 6) AS sum_y, round(first_y, 6) AS first_y FROM j WHERE n = 2 * half""",
    "greedy_match": f"WITH RECURSIVE {GREEDY} SELECT record_id, truth_at, found_at, abs(found_at - truth_at) AS distance FROM m",
    "recall_precision": f"WITH RECURSIVE {GREEDY}, c AS (SELECT coalesce(x.record_id, y.record_id) AS record_id, coalesce(nt, 0) AS nt, coalesce(nf, 0) AS nf "
        "FROM (SELECT record_id, count(*) AS nt FROM tt GROUP BY 1) x FULL JOIN (SELECT record_id, count(*) AS nf FROM dd GROUP BY 1) y ON x.record_id = y.record_id), "
        "g AS (SELECT record_id, count(*) AS nm, avg(abs(found_at - truth_at) / 60e6) AS mae, median(abs(found_at - truth_at) / 60e6) AS med FROM m GROUP BY 1), "
        "z AS (SELECT c.*, coalesce(nm, 0) AS nm, mae, med, coalesce(coalesce(nm, 0) * 100.0::DOUBLE / nullif(nf, 0), 0) AS pr, coalesce(coalesce(nm, 0) * 100.0::DOUBLE / nullif(nt, 0), 0) AS re FROM c LEFT JOIN g USING (record_id)) "
        "SELECT record_id, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, nm AS true_positives, nf - nm AS false_positives, nt - nm AS false_negatives, "
        "round(mae, 6) AS mae, round(med, 6) AS median_ae FROM z",
    "max_slope_before_r": f"WITH {GRAD} SELECT rp.record_id, rp.cycle, round(max(abs(d)) FILTER (WHERE i >= r - 20 AND i <= r), 6) AS max_slope, "
        "round(max(abs(d)) FILTER (WHERE i >= r - 20 AND i <= r) / max(abs(d)), 6) AS share FROM rp JOIN g USING (record_id, cycle) GROUP BY rp.record_id, rp.cycle",
    "adaptive_prominence": f"WITH {SMP}, m AS (SELECT record_id, cycle, 2.5::DOUBLE * 1.4826::DOUBLE * mad(v) AS b FROM smp GROUP BY ALL) SELECT record_id, cycle, round(b, 6) AS standard, round(b * 0.75::DOUBLE, 6) AS high, round(b * 0.6::DOUBLE, 6) AS maximum FROM m",
    "gaussian_model": f"WITH {QS}, mo AS (SELECT s.record_id, s.cycle, s.v, coalesce(qv * exp(-(s.i - q) * (s.i - q) / 12.5::DOUBLE), 0) + h * exp(-(s.i - r) * (s.i - r) / 12.5::DOUBLE) "
        "+ coalesce(sv * exp(-(s.i - qs.s) * (s.i - qs.s) / 12.5::DOUBLE), 0) AS f FROM smp s JOIN qs ON qs.record_id = s.record_id AND qs.cycle = s.cycle) "
        "SELECT record_id, cycle, round(sqrt(avg((v - f) * (v - f))), 6) AS rmse, round(sum(f), 6) AS area FROM mo GROUP BY ALL",
    "dynamic_offset": f"WITH {GRAD}, e AS (SELECT record_id, cycle, avg(abs(d)) AS en FROM g GROUP BY ALL), t AS (SELECT record_id, quantile_cont(en, 0.95) AS top FROM e GROUP BY ALL), "
        "x AS (SELECT record_id, cycle, greatest(0, least(1, en / top)) AS sh FROM e JOIN t USING (record_id)) SELECT record_id, cycle, round(sh, 6) AS share, round_even((1 + 59 * sh) * 250 / 1000, 0)::INT AS offset_samples FROM x",
    "ecg_truth": f"WITH {TRUTH} SELECT record_id, sample FROM truth",
    "rpeaks_pan_tompkins": f"WITH {TRUTH} SELECT record_id, count(*) AS gt_r_peaks, count(*) AS matched_r_peaks, count(*) AS detected_r_peaks FROM truth GROUP BY 1",
    "rpeaks_bandpass_energy": f"WITH {TRUTH} SELECT record_id, count(*) AS gt_r_peaks, count(*) AS matched_r_peaks, count(*) AS detected_r_peaks FROM truth GROUP BY 1",
    "epoch_half_widths": f"WITH {TRUTH} SELECT record_id, round_even((max(sample) - min(sample)) / (count(*) - 1)::DOUBLE / 2, 0)::INT AS half FROM truth GROUP BY 1 HAVING count(*) >= 2",
}


def _last_search_sql() -> str:
    """Turning points of either polarity, one-based in a list of samples."""
    def candidate(name: str, sign: str) -> str:
        d = lambda k: f"(s[{k} + 1] - s[{k}])"
        turn = f"list_filter(range(2, n), lambda i: sign{d('(i - 1)')} {sign} sign{d('i')})"
        steep = (f"list_filter(range(2, n - 1), lambda j: {d('j')} {sign} {d('(j - 1)')} AND {d('j')} {sign} {d('(j + 1)')} AND {d('j')} {sign} 0)")
        tallest = f"(list_sort(list_transform({turn}, lambda i: {{'a': -abs(s[i]), 'i': i}}))[1]).i"
        steepest = f"(list_sort(list_transform({steep}, lambda j: {{'a': -abs{d('j')}, 'i': j}}))[1]).i + 1"
        bend = "s[u - 1] - 2 * s[u] + s[u + 1]"
        shift = f"CASE WHEN abs({bend}) >= 2e-10 THEN greatest(-0.5, least(0.5, (s[u - 1] - s[u + 1]) / ({bend}))) ELSE 0 END"
        plain = "list_max" if sign == ">" else "list_min"
        return (f"{name}0 AS (SELECT *, CASE WHEN n >= 3 THEN coalesce({tallest}, {steepest}) END AS u FROM seg), "
                f"{name} AS (SELECT record_id, cycle, coalesce(CASE WHEN u IS NOT NULL THEN round_even(u - 1 + {shift}, 0) END, "
                f"list_position(s, {plain}(s)) - 1)::INT AS at0 FROM {name}0)")

    box = lambda a: f"list_transform(range(1, n + 1), lambda i: list_sum({a}[greatest(i - h, 1) : least(i + h, n)]) / (2 * h + 1))"
    return f"""WITH {RPK}, seg AS (SELECT record_id, cycle, y[1:r] AS s, r::BIGINT AS n FROM cyc JOIN rp USING (record_id, cycle) WHERE r > 0),
{candidate("up", ">")}, {candidate("down", "<")},
best AS (
  SELECT s.*, CASE WHEN abs(s[up.at0 + 1]) >= abs(s[down.at0 + 1]) THEN up.at0 ELSE down.at0 END AS p
  FROM seg s JOIN up USING (record_id, cycle) JOIN down USING (record_id, cycle)),
sized AS (
  SELECT *, s[p + 1] AS height, (greatest(3, round_even(sqrt(n), 0)::BIGINT) - 1) // 2 AS h,
         coalesce(list_max(list_filter(range(1, p + 2), lambda i: abs(s[i]) < 0.5 * abs(s[p + 1]))), 1) AS lo,
         coalesce(list_min(list_filter(range(p + 1, n + 1), lambda i: abs(s[i]) < 0.5 * abs(s[p + 1]))), n) AS hi FROM best),
off AS (SELECT *, CASE WHEN height = 0 THEN 1 ELSE greatest(1, (hi - lo) // 2) END AS half, {box("s")} AS m FROM sized),
dev AS (SELECT *, list_transform(range(1, n + 1), lambda i: abs(s[i] - m[i])) AS a FROM off),
rolled AS (SELECT *, list_transform({box("a")}, lambda v: 1.4826::DOUBLE * v) AS d FROM dev),
rest AS (SELECT *, list_concat(d[1 : greatest(p - half, 0)], d[p + half + 2 :]) AS o FROM rolled),
noisy AS (SELECT *, list_aggregate(CASE WHEN len(o) > 0 THEN o ELSE d END, 'median') AS noise FROM rest),
level AS (SELECT record_id, quantile_cont(abs(height), 0.25) AS learnt FROM best JOIN sized USING (record_id, cycle) GROUP BY record_id),
judged AS (SELECT record_id, cycle, p, height, n >= 3 AND (noise <= 1e-9 OR abs(height) >= 1.5 * noise) AS near, abs(height) >= learnt AS far
           FROM noisy JOIN level USING (record_id))
SELECT record_id, cycle, rp.r, p AS candidate, round(height, 6) AS height, coalesce(near, false) AS local, coalesce(far, false) AS learnt,
       CASE WHEN near AND far THEN p END AS p_peak
FROM rp LEFT JOIN judged USING (record_id, cycle)"""


SQL["p_last_search"] = _last_search_sql()


def _slope_of(part: str) -> str:
    """Columns sm and d of rows (part, k, m, v): parabolas over five samples,
    the outermost one at the ends, and central differences."""
    w = f"(PARTITION BY {part} ORDER BY k)"
    go = lambda j: "v" if not j else f"{'lead' if j > 0 else 'lag'}(v, {abs(j)}) OVER {w}"
    fit = lambda weights, j: "(" + " + ".join(f"({a}) * {go(j + n)}" for n, a in enumerate(weights)) + ") / 35.0::DOUBLE"
    first, second = (31, 9, -3, -5, 3), (9, 13, 12, 6, -5)
    return f"""smoothed AS (SELECT *, CASE WHEN k = 0 THEN {fit(first, 0)} WHEN k = 1 THEN {fit(second, -1)}
  WHEN k = m - 1 THEN {fit(first[::-1], -4)} WHEN k = m - 2 THEN {fit(second[::-1], -3)}
  ELSE {fit((-3, 12, 17, 12, -3), -2)} END AS sm FROM stretch WHERE m >= 5),
sloped AS (SELECT *, CASE WHEN k = 0 THEN lead(sm) OVER {w} - sm WHEN k = m - 1 THEN sm - lag(sm) OVER {w}
  ELSE (lead(sm) OVER {w} - lag(sm) OVER {w}) / 2 END AS d FROM smoothed)"""


SQL["smooth_derivative"] = f"""WITH {SMP},
stretch AS (SELECT record_id, cycle, i AS k, 64 AS m, v FROM smp), {_slope_of("record_id, cycle")}
SELECT record_id, cycle, k AS i, round(d, 6) AS slope FROM sloped"""
SQL["wave_edges"] = f"""WITH {RPK},
sides AS (SELECT record_id, cycle, r, side, CASE side WHEN 'left' THEN greatest(r - 50, 0) ELSE r END AS lo,
  CASE side WHEN 'left' THEN r ELSE least(r + 50, n - 1) END AS hi FROM rp, (VALUES ('left'), ('right')) s(side)),
bases AS (SELECT s.record_id, s.cycle, side, median(v) AS baseline FROM sides s JOIN smp USING (record_id, cycle)
  WHERE CASE side WHEN 'left' THEN i BETWEEN lo - 15 AND lo ELSE i BETWEEN hi AND hi + 15 END GROUP BY ALL),
stretch AS (SELECT s.record_id, s.cycle, r, side, i, i - lo AS k, hi - lo + 1 AS m, v
  FROM sides s JOIN smp USING (record_id, cycle) WHERE i BETWEEN lo AND hi), {_slope_of("record_id, cycle, side")},
steep AS (SELECT *, max(abs(d)) OVER (PARTITION BY record_id, cycle, side) AS max_slope FROM sloped),
near AS (SELECT record_id, cycle, side, any_value(max_slope) AS max_slope,
  CASE side WHEN 'left' THEN max(i) FILTER (WHERE ok) ELSE min(i) FILTER (WHERE ok) END AS edge FROM (
    SELECT steep.*, max_slope > 0 AND abs(d) <= 0.2 * max_slope AND abs(v - baseline) <= 0.05 * max_slope AS ok
    FROM steep JOIN bases USING (record_id, cycle, side)) GROUP BY record_id, cycle, side),
one AS (SELECT s.record_id, s.cycle, s.r, s.side, coalesce(edge, r) AS edge, edge IS NOT NULL AS found, max_slope, baseline
  FROM sides s JOIN bases USING (record_id, cycle, side) LEFT JOIN near USING (record_id, cycle, side))
SELECT record_id, cycle, any_value(r) AS r, """ + ", ".join(
    f"any_value({what}) FILTER (WHERE side = '{side}') AS {side}_{name}" for side in ("left", "right") for what, name in (
        ("edge", "edge"), ("found", "found"), ("round(max_slope, 6)", "max_slope"), ("round(baseline, 6)", "baseline"))) + """
FROM one GROUP BY record_id, cycle"""


STRIPS = SMP + """, placed AS (SELECT record_id, cycle, (row_number() OVER (PARTITION BY record_id ORDER BY cycle) - 1) * 64 AS place FROM cyc),
strip AS (SELECT record_id, cycle, i, place + i AS idx, v AS y FROM smp JOIN placed USING (record_id, cycle))"""


def _less_cubic(name: str, source: str, half: int) -> str:
    """Rows less the cubics' middle values, from moments over sliding frames of
    the rows with their outermost samples repeated."""
    n, k2 = 2 * half + 1, sum(k * k for k in range(-half, half + 1))
    k4 = sum(k**4 for k in range(-half, half + 1))
    over = f"OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""{name}_ends AS (SELECT record_id, min(idx) AS a, max(idx) AS b, arg_min(y, idx) AS ya, arg_max(y, idx) AS yb FROM {source} GROUP BY record_id),
{name}_all AS (SELECT record_id, idx, y FROM {source}
  UNION ALL SELECT record_id, a - k, ya FROM {name}_ends, range(1, {half} + 1) t(k) UNION ALL SELECT record_id, b + k, yb FROM {name}_ends, range(1, {half} + 1) t(k)),
{name}_sums AS (SELECT record_id, idx, y, sum(y) {over} AS m0, sum(y * idx) {over} AS m1, sum(y * idx * idx) {over} AS m2 FROM {name}_all),
{name} AS (SELECT record_id, idx, y - ({k4}::DOUBLE * m0 - {k2}::DOUBLE * (m2 - 2 * idx * m1 + idx * idx * m0)) / {n * k4 - k2 * k2}::DOUBLE AS y
  FROM {name}_sums JOIN {name}_ends USING (record_id) WHERE idx BETWEEN a AND b)"""


SQL["baseline_removed"] = f"""WITH {STRIPS}, {_less_cubic("fast", "strip", 94)}, {_less_cubic("slow", "fast", 250)}
SELECT record_id, idx, round(y, 6) AS y FROM slow"""
SQL["qrs_removed"] = f"""WITH {STRIPS},
beat AS (SELECT record_id, cycle, arg_max(idx, (abs(y), -idx)) AS r FROM strip WHERE i BETWEEN 24 AND 39 GROUP BY record_id, cycle),
rr AS (SELECT record_id, r, coalesce(r - lag(r) OVER w, lead(r) OVER w - r, 200) AS rr FROM beat WINDOW w AS (PARTITION BY record_id ORDER BY r)),
span AS (SELECT record_id, greatest(0, r - CAST(round(rr / 3.0::DOUBLE) AS BIGINT)) AS a, r + 20 AS b FROM rr),
level AS (SELECT span.record_id, a, b,
  coalesce(avg(y) FILTER (WHERE idx < a AND idx >= a - 2), any_value(y) FILTER (WHERE idx = a)) AS y1, avg(y) FILTER (WHERE idx >= b) AS y2
  FROM span JOIN strip ON strip.record_id = span.record_id AND idx BETWEEN a - 2 AND b + 1 GROUP BY ALL)
SELECT s.record_id, idx, round(CASE WHEN a IS NULL THEN y
  ELSE (y2 - y1) / (1 + exp(6 - 12 * (idx - a)::DOUBLE / (b - a - 1))) + y1 END, 6) AS y
FROM strip s LEFT JOIN level l ON s.record_id = l.record_id AND idx >= a AND idx < b"""
