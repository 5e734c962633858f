"""Secrets in texts: patterns, and strings that zstandard cannot shorten.

Patterns give the base findings.  Beyond them, every long unbroken string close
behind a word of secrecy is measured: a compressor primed with a dictionary of
the corpus's identifiers packs the surrounding text with and without the
string, and the difference is what the string costs.  Words, paths and names
that the dictionary or the surroundings know cost little; random strings cost
as many bytes as they have characters, or more, and are reported as ``novel``.

The dictionary holds the letters-only words that save most (documents with the
word times its length), counted over all documents, in ``DICTIONARY_BYTES``;
strings with digits never enter it, so a secret copied through the corpus does
not become known.  Other copies of a string are taken out of its surroundings
before it is measured.  Strings over ``PIECE`` characters are measured piece by
piece, whole.

Null texts have no findings; an empty table gives no rows and an empty
dictionary; repeated rows are scanned each.  ``with_findings`` adds or replaces
the column ``findings`` and leaves others alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.store import stored

DICTIONARY_BYTES = 32_768
DICTIONARY_WORDS = 8_192  # rows that reach the driver; words have 4 letters and more
AROUND = 512              # characters of surroundings on either side
REACH = 48                # characters behind a word of secrecy
PIECE = 64
NOVEL = 0.75              # bytes a character
LEVEL = 19

KINDS = ("assign", "access", "hex", "novel")
FINDINGS = "array<struct<kind:string,start:long,end:long,novelty:double>>"

# Fixed patterns: kind, expression, group whose length counts, its least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
SECRECY = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|key|auth|bearer|credential|private|signature|cookie|session|otp|jwt",
    re.IGNORECASE | re.ASCII)
STRING = re.compile(r"[A-Za-z0-9+/_~-][A-Za-z0-9+/_.~-]{14,}[A-Za-z0-9+/_~-]={0,2}")
WORD = r"[\p{L}_]{4,24}"


# -- dictionary -------------------------------------------------------------
def identifiers(docs: DataFrame) -> bytes:
    """The corpus's most saving words, the best last, where zstandard finds
    them at the least distance."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    counted = stored(docs.select(F.explode(words).alias("word")).groupBy("word").agg(
        (F.count(F.lit(1)) * F.octet_length("word")).alias("saved")), "words")
    best = [r["word"] for r in _most(counted, DICTIONARY_WORDS).orderBy(F.desc("saved"), "word").limit(DICTIONARY_WORDS).collect()]
    kept, size = [], 0
    for word in best:
        size += len(word.encode()) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(word)
    return " ".join(reversed(kept)).encode()


def _most(counted: DataFrame, limit: int) -> DataFrame:
    """The rows that can be among the first ``limit`` by ``saved``, and few
    others: tasks would each send ``limit`` rows to the driver else."""
    class_of = F.floor(F.log2("saved") * 16)
    classes = counted.groupBy(class_of.alias("c")).count().collect()  # some hundred, whatever the table
    taken, least = 0, None
    for r in sorted(classes, key=lambda r: -r["c"]):
        if taken >= limit:
            break
        taken, least = taken + r["count"], r["c"]
    return counted.where(class_of >= least) if least is not None else counted


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False}
    if len(dictionary) < 8:  # the least that zstandard takes
        return zstandard.ZstdCompressor(level=LEVEL, **options)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, **options)


# -- one text ---------------------------------------------------------------
def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, pattern, group, least in PATTERNS:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def novelty(text: str, start: int, end: int, dictionary: bytes) -> float:
    """Bytes a character that ``text[start:end]`` costs beside its surroundings."""
    string = text[start:end]
    before = text[max(0, start - AROUND):start].replace(string, " ")
    after = text[end:end + AROUND].replace(string, " ")
    packed = _compressor(dictionary)
    plain = len(packed.compress((before + after).encode()))
    pieces = [string[i:i + PIECE] for i in range(0, len(string), PIECE)]
    cost = sum(len(packed.compress((before + p + after).encode())) - plain for p in pieces)
    return cost / len(string)


def candidates(text: str, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Long strings within reach of a word of secrecy that ``known`` spans do
    not cover from end to end."""
    known = sorted(known)
    i = 0
    for m in STRING.finditer(text):
        start, end = m.span()
        if not SECRECY.search(text, max(0, start - REACH), start):
            continue
        while i < len(known) and known[i][1] <= start:
            i += 1
        reached, j = start, i
        while j < len(known) and known[j][0] <= reached < end:
            reached, j = max(reached, known[j][1]), j + 1
        if reached < end:
            yield start, end


def scan(text: str, dictionary: bytes) -> list[dict]:
    """Findings of one text by start, then kind, in code points."""
    found = [{"kind": k, "start": a, "end": b, "novelty": None} for k, a, b in base_spans(text)]
    for a, b in candidates(text, [(f["start"], f["end"]) for f in found]):
        cost = novelty(text, a, b, dictionary)
        if cost >= NOVEL:
            found.append({"kind": "novel", "start": a, "end": b, "novelty": cost})
    return sorted(found, key=lambda f: (f["start"], KINDS.index(f["kind"]), f["end"]))


# -- tables -----------------------------------------------------------------
def with_findings(docs: DataFrame, dictionary: bytes) -> DataFrame:
    @F.pandas_udf(FINDINGS)
    def findings(texts: pd.Series) -> pd.Series:
        return pd.Series([scan(t, dictionary) if t else [] for t in texts])

    return docs.withColumn("findings", findings("text"))
