"""Intermediate tables in the cluster's shared folder, and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.session import shared_folder, tune


# Small batches to and from Python: some texts are very long.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",  # ``in_turns`` bounds rows before they are shuffled
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return tune(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a
    lost executor costs its own tasks only."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)  # texts take disk, not time
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, key: str, limit: int, *ties: str) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of ``key``.  Large tables are
    thinned by that hash to some twice as many before, so that tasks do not
    each send ``limit`` rows to the driver."""
    n = df.count()
    if n > 2 * limit:
        share = int(2 * limit / n * (1 << 40))
        df = df.where(hash_order(key) < share)
    return df.orderBy(hash_order(key), key, *ties).limit(limit)


def hash_order(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 40))


def in_turns(df: DataFrame, key: str, limit: int, kind: str, *ties: Column) -> DataFrame:
    """``df`` with ``_turn``, the number of a row among those of its ``key`` and
    ``kind``, up to ``limit``: in this order repeated keys crowd out no other."""
    turn = F.row_number().over(Window.partitionBy(key, kind).orderBy(*ties))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= limit)


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row: rows equal in id and text share it."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))))
