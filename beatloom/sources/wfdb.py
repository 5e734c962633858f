"""Signal, annotation and subject readers for records in the WFDB layout."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions.kernels import array_udf
from beatloom.session import spread_over
from beatloom.sources.recordings import HALO_SECONDS

# Annotation codes of the published file format.
SYMBOLS = {
    1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q",
    14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D", 22: '"', 23: "=", 24: "p", 25: "B", 26: "^", 27: "t",
    28: "+", 29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(",
    40: ")", 41: "r",
}
PACKING = {16: (2, 1), 61: (2, 1), 160: (2, 1), 24: (3, 1), 32: (4, 1), 212: (3, 2), 310: (4, 3), 311: (4, 3)}
# storage formats that are read: bytes and samples of one group
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63
BEAT_SYMBOLS = ("N", "L", "R", "a", "V", "F", "J", "A", "S", "E", "j", "/", "Q")
_HEADER = ("record_id string, fs double, n_signals int, n_samples bigint, file string, "
           "format int, skip bigint, width int, place int, gain double, baseline double")
_FORMAT = re.compile(r"(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?")  # number, samples a frame, skew, bytes ahead


def _header(path: str, content: bytes, channel: int) -> dict | None:
    lines = [l.strip() for l in content.decode("latin-1").splitlines()]
    lines = [l for l in lines if l and not l.startswith("#")]
    first = lines[0].split()
    signals = [l.split() for l in lines[1 : 1 + int(first[1])]]
    if channel >= len(signals):
        raise ValueError(f"{path}: no channel {channel} among {len(signals)}")
    signal = signals[channel]
    number, frame, skew, skip = (int(g or d) for g, d in zip(_FORMAT.fullmatch(signal[1]).groups(), (0, 1, 0, 0)))
    # a file interleaves the signals that name it
    together = [k for k, other in enumerate(signals) if other[0] == signal[0]]
    if skew or any(int(_FORMAT.fullmatch(signals[k][1])[2] or 1) != 1 for k in together):
        raise ValueError(f"{path}: skewed signals and several samples a frame are not supported")
    gain, _, rest = signal[2].partition("(") if len(signal) > 2 else ("200", "", "")
    baseline = rest.partition(")")[0] or (signal[4] if len(signal) > 4 else "0")
    folder = path[: path.rfind("/") + 1]
    return {
        "record_id": first[0].split("/")[0], "n_signals": int(first[1]),
        "fs": float(first[2].split("/")[0]) if len(first) > 2 else 250.0,
        "n_samples": int(first[3]) if len(first) > 3 else 0,
        "file": folder + signal[0], "format": number, "skip": skip, "width": len(together), "place": together.index(channel),
        "gain": float(gain.split("/")[0]) or 200.0, "baseline": float(baseline),
    }


def read_headers(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """One row per record with what it takes to read one of its channels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hea").load(path)
    parse = array_udf(lambda path, content: _header(path, content, channel), _HEADER, strict=True)
    heads = files.select(parse("path", "content").alias("h")).select("h.*")
    # The number of samples may be left out; the signal file's size tells it.
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(path).select(F.col("path").alias("file"), "length")
    per = lambda k: F.create_map(*[F.lit(x) for f, group in PACKING.items() for x in (f, group[k])])[F.col("format")]
    known = F.floor((F.col("length") - F.col("skip")) * per(1) / (per(0) * F.col("width")))
    counted = heads.join(stored, "file", "left").withColumn("n_samples", F.when(F.col("n_samples") > 0, F.col("n_samples")).otherwise(known))
    return counted.select(*heads.columns)


def _unpacked(raw: np.ndarray, fmt: int) -> np.ndarray:
    """Samples of whole groups of a storage format."""
    u2 = raw.view("<u2").astype(np.int64) if fmt in (310, 311) else None
    signed = lambda v, bits: np.where(v >= 1 << (bits - 1), v - (1 << bits), v)
    if fmt in (16, 61):
        return raw.view("<i2" if fmt == 16 else ">i2").astype(np.int64)
    if fmt == 160:
        return raw.view("<u2").astype(np.int64) - 32768
    if fmt == 32:
        return raw.view("<i4").astype(np.int64)
    if fmt in (24, 212):
        trio = raw.reshape(-1, 3).astype(np.int64)
        if fmt == 24:
            return signed(trio[:, 0] | trio[:, 1] << 8 | trio[:, 2] << 16, 24)
        pair = np.stack([trio[:, 0] | (trio[:, 1] & 0x0F) << 8, trio[:, 2] | (trio[:, 1] & 0xF0) << 4], axis=1)
        return signed(pair.ravel(), 12)
    low, high = u2[0::2], u2[1::2]
    if fmt == 310:
        three = (low >> 1 & 0x3FF, high >> 1 & 0x3FF, low >> 11 | high >> 11 << 5)
    else:
        word = low | high << 16
        three = (word & 0x3FF, word >> 10 & 0x3FF, word >> 20 & 0x3FF)
    return signed(np.stack(three, axis=1).ravel(), 10)


def _samples(file, fmt, skip, width, place, gain, baseline, start, n):
    """One channel of samples [start, start + n), read by byte range."""
    fmt, width, n = int(fmt), int(width), int(n)
    if fmt not in PACKING:
        raise ValueError(f"{file}: storage format {fmt} is not supported")
    size, per = PACKING[fmt]
    group, ahead = divmod(int(start) * width, per)
    name = file.removeprefix("file://").removeprefix("file:")
    with open(name, "rb") as fh:
        fh.seek(int(skip) + group * size)
        raw = np.frombuffer(fh.read(-(-(ahead + n * width) // per) * size), np.uint8)
    # the last group of a file may be cut short
    raw = np.concatenate([raw, np.zeros(-raw.size % size, np.uint8)])
    values = _unpacked(raw, fmt)[ahead : ahead + n * width].astype(float)
    return (values[int(place) :: width] - baseline) / gain


def read_signals(
    spark: SparkSession, path: str, chunk_seconds: float = 300.0, halo_seconds: float = HALO_SECONDS, channel: int = 0,
) -> DataFrame:
    """Haloed chunk rows of one channel.  Tasks read byte ranges, so a record of any size
    is spread over as many tasks as it has chunks; the folder must be on a file
    system every executor mounts."""
    heads = read_headers(spark, path, channel)
    length = (F.bround(F.col("fs") * chunk_seconds / 2) * 2).cast("long")
    # an unknown format has no count here and must raise where it is read
    heads = heads.withColumn("n_samples", F.coalesce("n_samples", F.lit(1).cast("long")))
    cut = heads.where("n_samples > 0").withColumn("_len", length).withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, F.col("_len"))))
    cut = spread_over(cut.withColumn("chunk_id", F.floor(F.col("start") / F.col("_len"))), ["record_id", "chunk_id"])
    read = array_udf(_samples, "array<double>", strict=True)
    halo = (F.bround(F.col("fs") * halo_seconds / 2) * 2).cast("long")
    low = F.greatest(F.col("start") - halo, F.lit(0).cast("long"))
    high = F.least(F.col("start") + F.col("_len") + halo, F.col("n_samples"))
    return cut.select("record_id", "fs", "chunk_id", low.alias("start"),
                      read("file", "format", "skip", "width", "place", "gain", "baseline", low, high - low).alias("y"),
                      (F.col("start") - low).cast("int").alias("lead"),
                      F.least(F.col("_len"), F.col("n_samples") - F.col("start")).cast("int").alias("core"))


def _annotations(content: bytes) -> dict:
    words = np.frombuffer(content[: len(content) // 2 * 2], "<u2")
    at, i, samples, symbols = 0, 0, [], []
    while i < words.size:
        code, step = int(words[i]) >> 10, int(words[i]) & 0x3FF
        i += 1
        if code == 0 and step == 0:
            break
        if code == SKIP:
            at += int(np.int32(np.uint32(int(words[i]) << 16 | int(words[i + 1]))))
            i += 2
        elif code == AUX:
            i += (step + 1) // 2
        elif code not in (NUM, SUB, CHN):
            at += step
            samples.append(at)
            symbols.append(SYMBOLS.get(code, "?"))
    return {"sample": samples, "symbol": symbols}


def read_annotations(
    spark: SparkSession, path: str, extension: str = "atr", symbols: tuple[str, ...] | None = None,
) -> DataFrame:
    """(record_id, sample, symbol) rows, optionally of some symbols only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    parse = array_udf(_annotations, strict=True, returns="sample array<bigint>, symbol array<string>")
    rows = files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("record_id"), parse("content").alias("a")
    ).select("record_id", F.explode(F.arrays_zip("a.sample", "a.symbol")).alias("z")).select("record_id", "z.*")
    return rows if symbols is None else rows.where(F.col("symbol").isin(*symbols))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """(subject, age, sex) from header comments; ages outside (0, 150) are void."""
    lines = spark.read.option("pathGlobFilter", "*.hea").text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.hea$", 1).alias("subject"), "value")
    # Fixed patterns of the comment lines
    age = F.try_to_number(F.nullif(F.regexp_extract("value", r"(?i)age\D{0,3}(\d+)", 1), F.lit("")), F.lit("9999")).cast("int")
    sex = F.upper(F.nullif(F.regexp_extract("value", r"(?i)(?:sex|gender)\W{0,3}(m|f)", 1), F.lit("")))
    found = lines.groupBy("subject").agg(F.max(age).alias("age"), F.max(sex).alias("sex"))
    return found.withColumn("age", F.when((F.col("age") > 0) & (F.col("age") < 150), F.col("age")))
