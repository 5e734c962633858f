"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the library relies on.  Skewed joins must be split even
# when that costs an extra exchange: one record may hold a third of all rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a batch of 10,000 rows may hold 1 GB of samples, once in a worker and again in its executor
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a bare scan, its file sizes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, ``spark.checkpoint.dir``.

    In local mode, as in tests, a temporary one is set where the session names
    none; on a cluster every executor would write to a disk of its own.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="beatloom-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for tables that loops keep returning to."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where later steps need only some columns: unlike a checkpoint, the
    written table keeps column pruning and true file sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_over(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by ``keys`` into a fixed number of partitions.

    For rows that are few and small but costly to process: adaptive execution
    would merge their partitions by bytes and leave cores idle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-key ``stats`` of a few numbers each onto ``df``.

    Written first, they have a known size in bytes, by which Catalyst decides
    whether they are broadcast; if not, adaptive execution splits hot keys.
    """
    return df.join(written(stats), keys, "left")
