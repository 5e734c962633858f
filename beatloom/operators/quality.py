"""Signal quality per recording."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.functions import dsp as D
from beatloom.functions.kernels import array_udf

MIN_SAMPLES = 100


def _moments(y, lead, core, fs):
    """Sums of a chunk's core: signal, high band (or first difference when 40 Hz
    is out of reach) and slow wander."""
    y = np.asarray(y, float)
    own = slice(int(lead), int(lead) + int(core))
    if y.size <= 15:
        parts = [y[own], np.zeros(0), np.zeros(0)]
    else:
        noise = D.zero_phase(D.butterworth("high", 4, (40.0,), fs), y) if fs / 2 > 40 else np.diff(y)
        slow = D.zero_phase(D.butterworth("low", 4, (0.5,), fs), y) if fs / 2 > 0.5 else np.zeros(y.size)
        parts = [y[own], noise[own], slow[own]]
    out = {}
    for name, v in zip(("signal", "noise", "slow"), parts):
        out |= {f"{name}_n": int(v.size), f"{name}_s": float(v.sum()), f"{name}_ss": float(v @ v)}
    return out | {"lo": float(y[own].min()), "hi": float(y[own].max())}


def signal_quality(
    haloed: DataFrame, min_snr_db: float = 15.0, min_range_mv: float = 0.3, max_wander_mv: float = 0.3,
) -> DataFrame:
    """One advisory row per record; it never removes a recording.

    Chunks are reduced to sums where they lie and the sums are added per record,
    so a recording of any length costs one narrow row per chunk.
    """
    fields = [f"{p}_{q} {'bigint' if q == 'n' else 'double'}" for p in ("signal", "noise", "slow") for q in ("n", "s", "ss")]
    reduce = array_udf(_moments, ", ".join([*fields, "lo double", "hi double"]))
    sums = haloed.select("record_id", reduce("y", "lead", "core", "fs").alias("q")).select("record_id", "q.*")
    total = sums.groupBy("record_id").agg(
        *[F.sum(f.split()[0]).alias(f.split()[0]) for f in fields], F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def std(p):
        mean = F.try_divide(F.col(f"{p}_s"), F.col(f"{p}_n"))
        var = F.try_divide(F.col(f"{p}_ss"), F.col(f"{p}_n")) - mean * mean
        return F.sqrt(F.greatest(var, F.lit(0.0)))

    out = total.select(
        "record_id", F.col("signal_n").alias("n_samples"), std("signal").alias("signal_std_mv"), std("noise").alias("_noise"),
        (F.col("hi") - F.col("lo")).alias("amplitude_range_mv"), std("slow").alias("baseline_wander_std_mv"))
    # an immeasurable noise level counts as a rejected ratio
    out = out.withColumn("snr_db", F.when(
        (F.col("_noise") > 1e-9) & (F.col("signal_std_mv") > 0), 20 * F.log10(F.col("signal_std_mv") / F.col("_noise"))))
    text = lambda fmt, c: F.format_string(fmt, c)
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("snr_db").isNull(), F.lit("SNR not measurable")),
        F.when(F.col("snr_db") < min_snr_db, text(f"Low SNR (%.1f dB < {min_snr_db} dB)", F.col("snr_db"))),
        F.when(F.col("amplitude_range_mv") < min_range_mv,
               text(f"Low amplitude (%.3f mV < {min_range_mv} mV)", F.col("amplitude_range_mv"))),
        F.when(F.col("baseline_wander_std_mv") > max_wander_mv,
               text(f"High baseline wander (%.3f mV > {max_wander_mv} mV)", F.col("baseline_wander_std_mv"))),
    )
    short = F.col("n_samples") < MIN_SAMPLES
    reason = F.when(short, F.lit(f"Signal too short (< {MIN_SAMPLES} samples)")).otherwise(reasons)
    measured = ("snr_db", "amplitude_range_mv", "baseline_wander_std_mv", "signal_std_mv")
    return out.select(
        "record_id", (reason == "").alias("ok"), *[F.when(~short, F.col(c)).alias(c) for c in measured],
        reason.alias("reason"))
