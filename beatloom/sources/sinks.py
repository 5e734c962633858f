"""Result tables and run metadata on disk."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from dataclasses import asdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.config import Settings
from beatloom.session import written

LOW_RATE_HZ = 300.0


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by_record: bool = False) -> None:
    """Write a table; missing values become the literal NaN in CSV.

    ``by_record`` makes one folder per record, for a modest number of records;
    otherwise files follow the data's own partitioning.
    """
    writer = df.write.mode("overwrite")
    if by_record:
        writer = writer.partitionBy("record_id")
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NaN").option("emptyValue", "")
    writer.format(fmt).save(path)


def write_analysis(run, folder: str, fmt: str = "parquet", by_record: bool = False) -> dict[str, str]:
    """Beats, RR, HRV, variability and metadata below ``folder``; empty HRV and
    variability tables are skipped.  Returns the paths written."""
    tables = {"beats": run.beats, "rr_intervals": run.rr, "hrv_metrics": written(run.hrv()),
              "variability_metrics": written(run.variability())}
    out = {}
    for name, df in tables.items():
        if name in ("hrv_metrics", "variability_metrics") and df.isEmpty():
            continue
        out[name] = f"{folder}/{name}"
        write_table(df, out[name], fmt, by_record)
    rates = run.beats.agg(F.min("fs"), F.max("fs")).first()
    out["meta"] = f"{folder}/meta"
    write_metadata(run.beats.sparkSession, out["meta"], metadata(run.cfg, rates[0], rates[1]))
    return out


def read_features(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "csv") -> DataFrame:
    """Feature tables read back, with the file each row came from."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NaN")
    if schema:
        reader = reader.schema(schema)
    return reader.load(path).withColumn("source_file", F.input_file_name())


def metadata(cfg: Settings, lowest_rate: float | None = None, highest_rate: float | None = None) -> dict:
    settings = json.loads(json.dumps(asdict(cfg)))
    payload = {
        "version": cfg.version,
        "sampling_rate_hz": {"min": lowest_rate, "max": highest_rate},
        "config": settings,
        "config_sha256": cfg.sha256(),
        "runtime": {"python": sys.version.split()[0], "platform": platform.platform(), "numpy": np.__version__,
                    "pandas": pd.__version__, "pyspark": pyspark.__version__},
        "git": _git(),
        "code_sha256": _code_hash(),
    }
    if lowest_rate is not None and lowest_rate < LOW_RATE_HZ:
        payload["quality_warnings"] = {
            "q_s_wave_detection": f"Q and S are narrow: below {LOW_RATE_HZ:.0f} Hz their detection may suffer"}
    return payload


def write_metadata(spark: SparkSession, path: str, payload: dict) -> None:
    """One JSON document with sorted keys; numbers that JSON lacks are refused."""
    text = json.dumps(payload, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _git() -> dict:
    def run(*args: str) -> str | None:
        try:
            return subprocess.check_output(
                ["git", *args], stderr=subprocess.DEVNULL, cwd=Path(__file__).parent).decode().strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    return {"commit": run("rev-parse", "HEAD"), "branch": run("rev-parse", "--abbrev-ref", "HEAD"),
            "clean": run("status", "--porcelain") == ""}


def _code_hash() -> str:
    digest = hashlib.sha256()
    for file in sorted(Path(__file__).parents[1].rglob("*.py")):
        digest.update(file.read_bytes())
    return digest.hexdigest()
