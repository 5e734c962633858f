"""Views that read the given tables as RR series, cycles and edge series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators.ordered import Sequence, sequence
from beatloom.session import tune

NOMINAL_FS = 250.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rr_series(spark: SparkSession, sf_dir: str) -> Sequence:
    """One raw interval per event: record = user, ordered by (time, event)."""
    events = read(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").alias("record_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.lit(300.0) + F.lit(10.0) * F.col("value")).alias("rr_raw"),
        "event_type",
        "value",
    )
    return sequence(rows, ["record_id"], ["t_us", "event_id"])


def gated_rr(spark: SparkSession, sf_dir: str) -> Sequence:
    """Raw intervals with those outside 300-1800 ms set to NULL (``rr_ms``)."""
    ok = F.col("rr_raw").between(300, 1800)
    return rr_series(spark, sf_dir).with_columns({"rr_ms": F.when(ok, F.col("rr_raw"))})


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle per embedding: 64 samples, record = label."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("record_id"),
        F.col("vec_id").alias("cycle"),
        F.col("embedding").cast("array<double>").alias("y"),
    )


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per label: its embeddings laid end to end in order of their
    ids, as (record_id, cycle, place, y), ``place`` being the first sample's."""
    sized = cycles(spark, sf_dir).withColumn("n", F.size("y").cast("long"))
    rows = sequence(sized, ["record_id"], ["cycle"]).running_sum("n", "upto").rows()
    return rows.select("record_id", "cycle", (F.col("upto") - F.col("n")).alias("place"), "y")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave edges in samples for every lineitem row, some missing, some out of
    order."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = read(spark, sf_dir, "lineitem").select(
        *key, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    col = {c: F.col(c) for c in li.columns}
    p_le = F.floor(col["l_quantity"]).cast("double")
    q_le = (F.lit(70) + col["l_partkey"] % 40).cast("double")
    s_ri = q_le + 5 + col["l_suppkey"] % 30
    t_le = s_ri + F.floor(col["l_discount"] * 400)
    t_ri = t_le + 10 + col["l_partkey"] % 61
    return li.select(
        *key,
        F.when(col["l_returnflag"] != "R", p_le).alias("P_le_idx"),
        (p_le + 5 + 4 * col["l_linenumber"]).alias("P_ri_idx"),
        q_le.alias("Q_le_idx"),
        F.when(col["l_suppkey"] % 11 != 0, s_ri).alias("S_ri_idx"),
        t_le.alias("T_le_idx"),
        F.when(col["l_linestatus"] == "O", t_ri).when(col["l_partkey"] % 5 != 0, t_ri - 20).alias("T_ri_idx"),
        (F.lit(250.0) + col["l_extendedprice"] / 50.0).alias("rr_raw"),
    )
