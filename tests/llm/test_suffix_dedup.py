import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatloom.llm import suffix_dedup as sd
from beatloom.llm.queries import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(text):
    assert sd.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    """Spans of every (doc_id, text), each distinct row once, in order of id."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows},
                   key=lambda r: (r[0], r[1], hashlib.md5(f"{'-' if r[0] else r[1]}|{r[2]}".encode()).hexdigest()[:15]))
    seen, out = set(), {}
    for null, d, t in order:
        data = t.encode()
        starts = []
        for i in range(len(data) - sd.LENGTH + 1):
            s = data[i : i + sd.LENGTH]
            if s in seen:
                starts.append(i)
            seen.add(s)
        out[None if null else d, t] = sd.removed(len(data), [], starts)
    return out


def check(spark, rows, sizes=sd.Sizes()):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    derive = {"spans": F.col("cut.spans"), "kept": F.col("cut.kept")}
    got = sd.deduplicate(docs.withColumn("again", F.coalesce("text", F.lit(""))), derive, sizes=sizes).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert spans == want[r["doc_id"], r["again"]], (r["doc_id"], len(r["again"]))
        data, at, kept = r["again"].encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        assert bytes(r["kept"]) == kept + data[at:]


def passages(seed):
    rng = random.Random(seed)

    def letters(n, alphabet="abcdefgh ij"):
        return "".join(rng.choice(alphabet) for _ in range(n))

    shared = [letters(n) for n in (60, 99, 100, 101, 130, 149, 150, 160, 260, 700)]
    rows = [(k, "".join(letters(rng.randrange(5, 90)) + rng.choice(shared) for _ in range(rng.randrange(1, 5))) + letters(9)) for k in range(60)]
    near = letters(900)
    for k in range(60, 90):
        t = list(near)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "é"
        rows.append((k, "".join(t)))
    rows += [(k, near) for k in range(90, 110)] + [(200, "x" * 5000), (201, "x" * 99), (202, "xy" * 300), (203, None), (204, ""), (None, near[:300]),
                                                   (7, "same id " + near[:200]), (205, "é" * 70), (206, "zé" * 70), (90, near), (50_000, letters(20_000))]
    return rows


def test_passages_and_copies(spark):
    check(spark, passages(1))


@pytest.mark.parametrize("hot,shard", [(3, 10), (10**9, 5)])
def test_hot_anchors_and_many_packs(spark, hot, shard):
    check(spark, passages(2), sd.Sizes(pack=2000, part=3000, shard=shard, hot=hot))


@pytest.mark.parametrize("pack", [1, 1 << 20])
def test_repeated_rows_keep_what_occurs_nowhere_else(spark, pack):
    rng = random.Random(3)
    alone, inside = ("".join(rng.choice("abcdefgh ij") for _ in range(n)) for n in (700, 400))
    rows = [(5, alone), (6, "other " + inside), (7, inside + inside), (None, alone[:250] + "end"), (8, "short")]
    check(spark, rows * 4 + [(5, alone)] * 30, sd.Sizes(pack=pack))


def test_clean_keeps_columns_and_characters(spark):
    base = "é" * 60 + "a plain passage of text " * 6
    rows = [(1, base, "en", "s", 1, "x"), (2, "ü" + base + "ç", "en", "s", 2, "y"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cut string")
    got = {r["doc_id"]: r for r in sd.clean(docs).collect()}
    assert sd.clean(docs).columns == docs.columns
    assert got[2]["text"].startswith("ü") and got[2]["text"].endswith("ç") and got[2]["n_chars"] == len(got[2]["text"]) < 5
    assert got[None]["text"] is None and got[1]["cut"] == "x"
    assert sd.clean(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    text = dict(rows)
    for r in QUERIES["op5_suffix_dedup"](spark, sf).collect():
        spans, data = want[r["doc_id"], text[r["doc_id"]] or ""], (text[r["doc_id"]] or "").encode()
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept + data[at:]).hexdigest()
