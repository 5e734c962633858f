"""Running the batch analysis on recordings as they arrive.

The analysis itself has no streaming operators; a stream of recording files is
handled as a sequence of batches, each written once under its batch number, so
that a replayed batch overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from beatloom.config import Settings
from beatloom.plans.pipeline import analyze
from beatloom.schema import RECORDINGS
from beatloom.sources.recordings import from_arrays


def stream_recordings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORDINGS).parquet(folder)


def analyze_stream(
    recordings: DataFrame, out: str, checkpoint: str, cfg: Settings | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Write beats and RR intervals of every arriving recording below ``out``."""
    def each(batch: DataFrame, number: int) -> None:
        run = analyze(from_arrays(batch), cfg)
        run.beats.write.mode("overwrite").parquet(f"{out}/beats/batch={number}")
        run.rr.write.mode("overwrite").parquet(f"{out}/rr/batch={number}")

    writer = recordings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
