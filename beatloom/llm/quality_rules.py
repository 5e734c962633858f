"""Host-level quality rules with empirical-Bayes shrinkage, all in expressions.

1. Per document: words, symbols, repeated lines, words in repeated three-word
   windows, capitals.  A base rule rejects documents of under 50 words or with
   over half of their words in repeated windows.
2. Per host (``source``): how many documents fail each strict rule.  The rates
   of all hosts give a beta prior per rule (moments), and every host's rate is
   shrunk towards it: (failures + a) / (documents + a + b).
3. Back to the documents: loose limits hold everywhere, strict ones in hosts
   whose shrunk failure rate of that rule is above ``HOST_LIMIT``.

Null text: no words, so it fails the base rule.  A null source is a host of
its own.  Repeated rows count as documents each.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.store import stored

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"[A-ZÀ-ÖØ-Þ]"
HOST_LIMIT = 0.2
# Documents a host with no spread between hosts is shrunk by.
NO_SPREAD = 1e6
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * ``part`` is over ``limit`` * ``whole``."""

    name: str
    part: str
    whole: str
    strict: int
    loose: int

    def fails(self, limit: int) -> Column:
        return F.col(self.part) * 100 > F.col(self.whole) * limit


RULES = (
    Rule("symbols", "n_symbols", "n_words", 10, 30),
    Rule("lines", "n_dup_lines", "n_lines", 30, 60),
    Rule("capitals", "n_capitals", "word_chars", 30, 60),
)


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at these ascending positions."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        positions, start,
        lambda acc, x: F.struct(x.cast("int").alias("last"), (acc["total"] + F.least(F.lit(3), x.cast("int") - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_capitals, base_failed."""
    own = docs.columns
    low = (1 << POSITION_BITS) - 1
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        *own,
        F.array_remove(F.split(body, BLANK), "").alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(CAPITALS)).cast("long").alias("n_capitals"),
    )
    df = df.withColumn("_n", F.size("_w"))

    def window(i: Column) -> list[Column]:
        return [F.get("_w", i + k) for k in range(3)]

    at = F.sequence(F.lit(0), F.col("_n") - 3)
    none = F.array().cast("array<bigint>")
    # Window hashes above, positions below: one primitive sort brings equal
    # windows together.
    packed = F.transform(at, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    df = df.withColumn("_s", F.when(F.col("_n") >= 3, F.sort_array(packed)).otherwise(none))

    def alike(x: Column, y: Column) -> Column:
        return F.shiftright(x, POSITION_BITS).eqNullSafe(F.shiftright(y, POSITION_BITS))

    twice = F.filter("_s", lambda x, j: alike(x, F.get("_s", j - 1)) | alike(x, F.get("_s", j + 1)))
    df = df.withColumn("_d", twice)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def differ(x: Column, y: Column) -> Column:
        a, b = window(place(x)), window(place(y))
        return ~(a[0].eqNullSafe(b[0]) & a[1].eqNullSafe(b[1]) & a[2].eqNullSafe(b[2]))

    clash = F.size(F.filter("_d", lambda x, j: (j > 0) & alike(x, F.get("_d", j - 1)) & differ(x, F.get("_d", j - 1)))) > 0
    df = df.withColumn("_clash", clash | (F.col("_n") > low))
    # Where two windows share a hash, or positions do not fit, whole windows
    # are sorted instead.
    full = F.sort_array(F.transform(at, lambda i: F.struct(F.array(*window(i)).alias("w"), i.alias("i"))))
    df = df.withColumn("_f", F.when(F.col("_clash"), full))
    exact = F.filter("_f", lambda x, j: x["w"].eqNullSafe(F.get("_f", j - 1)["w"]) | x["w"].eqNullSafe(F.get("_f", j + 1)["w"]))
    places = F.when(F.col("_clash"), F.transform(exact, lambda x: x["i"])).otherwise(F.transform("_d", place))
    df = df.withColumn("_p", F.sort_array(places))
    n_words = F.col("_n").cast("long")
    df = df.select(
        *own, n_words.alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols", F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_p")).alias("n_repeat_words"), "n_capitals",
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, and per rule failures, prior-shrunk rate
    and verdict.  Only the moments, a few numbers a rule, reach the driver."""
    counts = [F.count(F.when(r.fails(r.strict), 1)).alias(f"{r.name}_failed") for r in RULES]
    hosts = stored(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *counts), "hosts")
    first = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        *[F.sum(f"{r.name}_failed").alias(r.name) for r in RULES],
        *[F.sum(F.col(f"{r.name}_failed").cast("double") * F.col(f"{r.name}_failed") / F.col("n")).alias(f"{r.name}_sq") for r in RULES],
    ).first()
    out = hosts
    for r in RULES:
        mean = first[r.name] / first["n"] if first["n"] else 0.0
        strength = NO_SPREAD
        if 0 < mean < 1 and first["hosts"] > 1:
            spread = first[f"{r.name}_sq"] - first["n"] * mean * mean  # sum of n (rate - mean)^2
            scale = first["n"] - first["nn"] / first["n"] - first["hosts"] + 1
            rho = (spread - mean * (1 - mean) * (first["hosts"] - 1)) / (mean * (1 - mean) * scale) if scale > 0 else 0.0
            if rho > 0:
                strength = min(NO_SPREAD, max(1 / rho - 1, 0.0))
        rate = (F.col(f"{r.name}_failed") + mean * strength) / (F.col("n") + F.lit(float(strength)))
        out = out.withColumn(f"{r.name}_rate", rate).withColumn(f"{r.name}_strict", rate > HOST_LIMIT)
    return out


def judged(measured: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` and host_flagged, kept.  ``measured`` is read twice, so
    pass a stored table."""
    hosts = stored(host_rates(measured, host).select(F.col("host").alias("_host"), *[f"{r.name}_strict" for r in RULES]), "verdicts")
    joined = measured.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")
    bad, flagged = F.col("base_failed"), F.lit(False)
    for r in RULES:
        strict = F.coalesce(F.col(f"{r.name}_strict"), F.lit(False))
        bad = bad | r.fails(r.loose) | (strict & r.fails(r.strict))
        flagged = flagged | strict
    return joined.select(*[measured[c] for c in measured.columns], flagged.alias("host_flagged"), (~bad).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    measured = stored(with_measures(renamed, place["text"]), "measured")
    kept = judged(measured, place["source"]).where("kept")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
