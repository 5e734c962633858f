import random
import re
from collections import Counter

from beatloom.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(2)
    some = [" ".join(rng.choice("ab c d\tee \n ## é x |".split(" ")) for _ in range(rng.randrange(300))) for _ in range(40)]
    return some + [None, "", "   ", "a", "a a", "a a a", "a a a a", "x y z\nx y z\n\nx y z", "word " * 20_000, " wide ", "b" * 100_000]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts())], "doc_id long, text string, n_words string")
    got = {r[0]: tuple(r)[1:7] for r in qr.with_measures(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}


def test_clashing_hashes_take_the_exact_path(spark, monkeypatch):
    monkeypatch.setattr(qr, "POSITION_BITS", 56)  # seven bits of hash are left
    docs = spark.createDataFrame([(0, " ".join(str(k % 700) for k in range(1000)))], "doc_id long, text string")
    assert qr.with_measures(docs).first()["n_repeat_words"] == brute(" ".join(str(k % 700) for k in range(1000)))[5]


def test_strict_hosts_and_stage(spark):
    good = " ".join(f"word{i}" for i in range(100))
    odd = good + " #" * 15  # over the strict limit of symbols, under the loose one
    rows = [(i, good, "clean", "kept") for i in range(200)] + [(1000 + i, odd, "spam", "x") for i in range(90)]
    rows += [(1, odd, "clean", "x"), (2000, good, "spam", "x"), (3000, None, None, None), (3001, good + " #" * 60, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    measured = qr.stored(qr.with_measures(docs))
    out = {(r["doc_id"], r["source"], r["n_symbols"]): r for r in qr.judged(measured).collect()}
    assert len(out) == len(rows)
    assert not out[1005, "spam", 15]["kept"] and out[1, "clean", 15]["kept"] and out[2000, "spam", 0]["kept"]
    assert not out[3000, None, 0]["kept"] and not out[3001, None, 60]["kept"]
    rates = {r["host"]: r["symbols_rate"] for r in qr.host_rates(measured).collect()}
    assert 1 / 201 <= rates["clean"] < rates["spam"] < 90 / 91 + 0.01
    kept = qr.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 202
    assert qr.kept_documents(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    plan = qr.judged(qr.with_measures(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
