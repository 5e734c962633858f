"""Baseline and QRS removal over haloed chunks, without seams between them.

Both keep the chunk layout and add a ``reason``: a recording with a missing
sample is refused whole, a chunk whose halo is too short to know its core is
refused alone; both keep their rows with NULL samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.functions import bridges as B
from beatloom.functions.kernels import array_udf
from beatloom.operators.ordered import sequence
from beatloom.session import attach, spread_over, written
from beatloom.sources.recordings import MISSING

SHORT = "halo too short"
CLEANED = "y array<double>, short boolean"


def _recordings(chunks: DataFrame) -> DataFrame:
    """Length, chunk length and soundness of every recording."""
    gap = F.coalesce(F.exists("y", lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    return chunks.groupBy("record_id").agg(
        F.max("fs").alias("_fs"), F.sum("core").cast("long").alias("_n"), F.max("core").cast("long").alias("_length"),
        F.max(F.greatest("lead", F.size("y") - F.col("lead") - F.col("core"))).cast("long").alias("_halo"),
        F.max(gap).alias("_bad"))


def _ends(start, size, n) -> tuple[bool, bool]:
    return start == 0, start + size >= n


def _answered(rows: DataFrame, columns: list[str]) -> DataFrame:
    reason = F.when(F.col("_bad"), F.lit(MISSING)).when(F.col("_out.short"), F.lit(SHORT))
    return rows.withColumns({"y": F.col("_out.y"), "reason": reason}).select(*columns, "reason")


def remove_baseline(chunks: DataFrame, widths_ms: tuple[float, float] = B.BASELINE_MS) -> DataFrame:
    """Subtract a cubic fitted over the first width, then one over the second.

    Beyond the ends of a recording its outermost samples are repeated.  A width
    under five samples or not shorter than the recording is left out.
    """
    def clean(y, fs, start, lead, core, n):
        halves = B.half_widths(fs, n, widths_ms)
        (first, last), need = _ends(start, len(y), n), sum(halves)
        short = (not first and lead < need) or (not last and len(y) - lead - core < need)
        return {"y": None if short else B.without_baseline(y, halves), "short": short}

    rows = attach(chunks, _recordings(chunks), ["record_id"])
    y = F.when(~F.col("_bad"), F.col("y"))
    rows = rows.withColumn("_out", array_udf(clean, CLEANED, strict=True)(y, "fs", "start", "lead", "core", "_n"))
    return _answered(rows, chunks.columns)


def qrs_spans(chunks: DataFrame, beats: DataFrame) -> DataFrame:
    """(record_id, r_idx, from_idx, to_idx) of the bridge over every beat.

    ``beats`` holds record_id, r_idx and, where known, s_offset.  A bridge starts
    a third of the RR behind it ahead of R (the first beat: of the RR ahead; a
    lone beat: of 0.8 s) and ends 80 ms behind R or 50 ms behind S, inside the
    recording.  Positions given twice count once, with the later S; beats without
    position or recording and bridges of no length have no row.
    """
    s_offset = F.col("s_offset") if "s_offset" in beats.columns else F.lit(None)
    s_offset = s_offset.cast("double")
    one = beats.where("record_id IS NOT NULL AND r_idx IS NOT NULL").select(
        "record_id", F.col("r_idx").cast("long").alias("r_idx"), F.when(~F.isnan(s_offset), s_offset).alias("s_offset"),
    ).groupBy("record_id", "r_idx").agg(F.max("s_offset").alias("s_offset"))
    r = F.col("r_idx")
    near = sequence(one, ["record_id"], ["r_idx"]).near(
        lambda w: {"_before": F.lag("r_idx").over(w), "_next": F.lead("r_idx").over(w)}, before=1, after=1)
    rows = attach(near.rows(), _recordings(chunks).select("record_id", "_fs", "_n"), ["record_id"]).where("_n IS NOT NULL")
    rr = F.coalesce(r - F.col("_before"), F.col("_next") - r, F.bround(F.lit(B.LONE_RR_MS / 1000) * F.col("_fs")).cast("long"))
    right = F.coalesce(
        F.bround(F.col("s_offset") - r + F.lit(B.BEHIND_S_MS / 1000) * F.col("_fs")), F.bround(F.lit(B.RIGHT_MS / 1000) * F.col("_fs")))
    return rows.select(
        "record_id", "r_idx", F.greatest(F.lit(0).cast("long"), r - F.round(rr / B.LEFT_SHARE).cast("long")).alias("from_idx"),
        F.least(F.col("_n"), r + right.cast("long")).alias("to_idx")).where("from_idx < to_idx")


def remove_qrs(chunks: DataFrame, beats: DataFrame) -> DataFrame:
    """Write a logistic bridge over every QRS complex of haloed chunks.

    Every chunk gets the bridges that reach its samples, halo included, so a
    bridge across a border is written alike on both sides.  Bridges that overlap
    see the one before; what a chunk cannot know of those before its halo shrinks
    with every bridge, and the chunk is refused where it is still felt in the core.
    """
    def clean(y, fs, start, lead, core, n, spans):
        first, last = _ends(start, len(y), n)
        level = max(1, int(round(B.LEVEL_MS * fs / 1000.0)))
        cuts = np.array([[s["from_idx"], s["to_idx"]] for s in spans], dtype=np.int64).reshape(-1, 2) - start
        x, doubt = B.bridged(y, cuts[:, 0], cuts[:, 1], first, last, level)
        short = bool((doubt[lead : lead + core] > B.DOUBT).any())
        return {"y": None if short else x, "short": short}

    key = ["record_id", "chunk_id"]
    known = written(_recordings(chunks))
    spans = qrs_spans(chunks, beats).join(known.select("record_id", "_length", "_halo"), "record_id")
    at = lambda position: F.floor(position / F.col("_length"))
    reach = F.sequence(F.greatest(F.lit(0).cast("long"), at(F.col("from_idx") - F.col("_halo"))), at(F.col("to_idx") + F.col("_halo")))
    sent = spans.select("record_id", F.struct("r_idx", "from_idx", "to_idx").alias("_span"), F.explode(reach).alias("chunk_id"))
    lists = spread_over(sent, key).groupBy(*key).agg(F.array_sort(F.collect_list("_span")).alias("_spans"))
    none = F.array().cast("array<struct<r_idx:bigint,from_idx:bigint,to_idx:bigint>>")
    rows = chunks.join(known, "record_id", "left").join(lists, key, "left").withColumn("_spans", F.coalesce("_spans", none))
    y = F.when(~F.col("_bad"), F.col("y"))
    rows = rows.withColumn("_out", array_udf(clean, CLEANED, strict=True)(y, "fs", "start", "lead", "core", "_n", "_spans"))
    return _answered(rows, chunks.columns)
