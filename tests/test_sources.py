from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.config import Settings
from beatloom.operators import age_model as AM
from beatloom.plans.pipeline import analyze
from beatloom.schema import RECORDINGS
from beatloom.session import written
from beatloom.sources import sinks, wfdb
from beatloom.sources.synthetic import simulate_ecg
from beatloom.streaming.incremental import analyze_stream, stream_recordings


def encode_annotations(pairs: list[tuple[int, str]]) -> bytes:
    """The inverse of the annotation reader, for round-trip checks."""
    codes = {s: c for c, s in wfdb.SYMBOLS.items()}
    out, last = [], 0
    for at, symbol in pairs:
        step = at - last
        if step > 0x3FF:
            out += [wfdb.SKIP << 10, (step >> 16) & 0xFFFF, step & 0xFFFF]
            step = 0
        out.append(codes[symbol] << 10 | step)
        last = at
    return np.array([*out, 0], "<u2").tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wfdb")
    rng = np.random.default_rng(0)
    a = rng.integers(-2048, 2047, (1001, 2))
    flat = np.append(a.ravel(), [0] * (a.size % 2)).astype(int) & 0xFFF
    x, y = flat[0::2], flat[1::2]
    raw = np.stack([x & 0xFF, (x >> 8) | (y >> 8) << 4, y & 0xFF], axis=1).astype(np.uint8)
    (root / "s1.dat").write_bytes(raw.tobytes())
    (root / "s1.hea").write_text("s1 2 250 1001\ns1.dat 212 200(10)/mV 12 0\ns1.dat 212 200 12 0\n# Age: 69  Sex: M\n")
    b = rng.integers(-30000, 30000, 777).astype("<i2")
    (root / "s2.dat").write_bytes(b.tobytes())
    (root / "s2.hea").write_text("s2 1 100/0 777\ns2.dat 16 1000 16 0\n# <age>: 250 <sex>: F\n")
    (root / "s1.atr").write_bytes(encode_annotations([(5, "N"), (200, "V"), (5000, "+"), (70000, "N")]))
    return str(root), a[:, 0], b


def test_signals_by_byte_range(spark, folder):
    root, a, b = folder
    rows = wfdb.read_signals(spark, root, chunk_seconds=1.0, halo_seconds=0.0).orderBy("record_id", "chunk_id").collect()
    got = {r: np.concatenate([x.y for x in rows if x.record_id == r]) for r in ("s1", "s2")}
    np.testing.assert_allclose(got["s1"], (a - 10) / 200)
    np.testing.assert_allclose(got["s2"], b / 1000)
    assert len([x for x in rows if x.record_id == "s1"]) == 5


def test_annotations_and_subjects(spark, folder):
    rows = wfdb.read_annotations(spark, folder[0]).orderBy("sample").collect()
    assert [(r.sample, r.symbol) for r in rows] == [(5, "N"), (200, "V"), (5000, "+"), (70000, "N")]
    assert wfdb.read_annotations(spark, folder[0], symbols=wfdb.BEAT_SYMBOLS).count() == 3
    got = {r.subject: (r.age, r.sex) for r in wfdb.read_subjects(spark, folder[0]).collect()}
    assert got == {"s1": (69, "M"), "s2": (None, "F")}


@pytest.fixture(scope="module")
def run(spark):
    chunks, _ = simulate_ecg(spark, records=2, seconds=75.0)
    return analyze(written(chunks), Settings.for_human(), single=True)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sinks_round_trip(spark, run, tmp_path, fmt):
    paths = sinks.write_analysis(run, str(tmp_path), fmt)
    assert set(paths) == {"beats", "rr_intervals", "hrv_metrics", "variability_metrics", "meta"}
    back = sinks.read_features(spark, paths["beats"], run.beats.schema.simpleString()[7:-1].replace(":", " ") if fmt == "csv" else None, fmt)
    total = lambda df: [df.agg(F.sum(c)).first()[0] for c in ("R_global_center_idx", "RR_interval_ms")]
    np.testing.assert_allclose(total(back), total(run.beats))
    meta = json.loads(spark.read.text(paths["meta"]).first()[0])
    assert meta["config_sha256"] == run.cfg.sha256() and "quality_warnings" in meta
    if fmt == "csv":
        text = spark.read.text(paths["rr_intervals"]).count()
        assert text >= run.rr.count()
        assert spark.read.text(paths["beats"]).where(F.col("value").contains(",NaN")).count() > 0


def test_empty_tables_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([("flat", 250.0, 0, 0, [0.0] * 2000)], "record_id string, fs double, chunk_id bigint, start bigint, y array<double>")
    paths = sinks.write_analysis(analyze(df, Settings.for_human(), single=True), str(tmp_path))
    assert "hrv_metrics" not in paths and "beats" in paths


def test_metadata_refuses_nan(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_metadata(spark, str(tmp_path / "m"), {"x": float("nan")})


def test_stream_of_recordings(spark, tmp_path):
    chunks, _ = simulate_ecg(spark, records=3, seconds=40.0)
    rows = written(chunks).select("record_id", "fs", F.lit("human").alias("species"), F.lit("II").alias("lead"), F.col("y").alias("signal"))
    rows.where("record_id < '2'").write.parquet(str(tmp_path / "in"))
    go = lambda: analyze_stream(stream_recordings(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    first = spark.read.parquet(str(tmp_path / "out/beats")).count()
    rows.where("record_id = '2'").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    beats = spark.read.parquet(str(tmp_path / "out/beats"))
    assert first > 60 and beats.count() > first and beats.select("record_id").distinct().count() == 3
    assert spark.read.schema(RECORDINGS).parquet(str(tmp_path / "in")).count() == 3


def test_age_models(spark):
    rng = np.random.default_rng(0)
    age = rng.uniform(20, 80, 120)
    rows = [(i, float(a), "M" if i % 2 else "F", float(2 * a + rng.normal(0, 3)), float(rng.normal())) for i, a in enumerate(age)]
    df = spark.createDataFrame(rows, "subject long, age double, sex string, f1 double, f2 double")
    scores, fitted = AM.evaluate_models(df, ["f1", "f2"], top_k=2, folds=2, models=("elastic_net", "random_forest"))
    got = {r.model: r for r in scores.collect()}
    again, _ = AM.evaluate_models(df.repartition(5), ["f1", "f2"], top_k=2, folds=2, models=("elastic_net",))
    assert again.first().cv_mae == pytest.approx(got["elastic_net"].cv_mae, rel=1e-6)
    assert got["elastic_net"].r2 > 0.9 and got["elastic_net"].cv_mae < 6
    assert AM.importances(fitted["random_forest"], ["f1", "f2"])[0][0] == "f1"


def test_wfdb_without_counts_and_with_unknown_formats(spark, tmp_path):
    values = np.arange(-300, 300, dtype="<i2")
    (tmp_path / "a.dat").write_bytes(values.tobytes())
    (tmp_path / "a.hea").write_text("a 1 100\na.dat 16 200 11 0\n")
    chunks = wfdb.read_signals(spark, str(tmp_path), chunk_seconds=2.0, halo_seconds=0.0).orderBy("start").collect()
    np.testing.assert_allclose(np.concatenate([c.y for c in chunks]), values / 200.0)
    (tmp_path / "b.dat").write_bytes(b"\0" * 100)
    (tmp_path / "b.hea").write_text("b 1 100 100\nb.dat 80 200 8 0\n")
    with pytest.raises(Exception, match="storage format 80"):
        wfdb.read_signals(spark, str(tmp_path)).collect()
