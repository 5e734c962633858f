"""Base findings against a character-by-character reading; planted secrets."""

import hashlib
import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beatloom.llm import secrets as S
from beatloom.llm.queries import QUERIES

CLASS = set(string.ascii_letters + string.digits + "+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def lower(c):
    return c.lower() if c in string.ascii_uppercase else c


def runs(text, members, starts=""):
    i = 0
    while i < len(text):
        if text.startswith(starts, i) and (starts or text[i] in members):
            j = i + len(starts)
            while j < len(text) and text[j] in members:
                j += 1
            if j > i + len(starts):
                yield i, j
                i = j
                continue
        i += 1


def assignments(text):
    low, i = "".join(map(lower, text)), 0
    while i < len(text):
        end = None
        for name in NAMES:
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            j += text[j:j + 1] in ('"', "'") and text[j:j + 1] != ""
            while text[j:j + 1] == " ":
                j += 1
            if text[j:j + 1] not in (":", "=") or not text[j:j + 1]:
                continue
            j += 1
            while text[j:j + 1] == " ":
                j += 1
            j += text[j:j + 1] in ('"', "'") and text[j:j + 1] != ""
            k = j
            while k < len(text) and text[k] in CLASS:
                k += 1
            if k > j:
                end = k
                if k - j >= 12:
                    yield i, k
                break
        i = end or i + 1


def base(text):
    found = [("assign", a, b) for a, b in assignments(text)]
    found += [("access", a, b) for a, b in runs(text, set(string.ascii_uppercase + string.digits), "AKIA") if b - a >= 18]
    found += [("hex", a, b) for a, b in runs(text, set("0123456789abcdef")) if b - a >= 16]
    return sorted(found, key=lambda f: (f[1], S.KINDS.index(f[0])))


PIECES = st.sampled_from([*NAMES, "Token", "PASSWORD", "AKIA", "AKIAAKIA", "0123456789abcdef", "ABCDEF0123456789", " ", '"', "'", ":", "=",
                          "\n", "é", "ſecret", "\U0001f600", "x", "-_./+", "abcdefghijkl"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans(text):
    got = sorted(S.base_spans(text), key=lambda f: (f[1], S.KINDS.index(f[0])))
    assert got == base(text)
    assert [(f["kind"], f["start"], f["end"]) for f in S.scan(text, b"") if f["kind"] != "novel"] == got


def prose(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(300)]
    return " ".join(rnd.choices(words, k=n)), words


def planted(n=120):
    rnd = random.Random(7)
    alphabet = string.ascii_letters + string.digits
    text, words = prose(120)
    for i in range(n):
        secret = "".join(rnd.choices(alphabet, k=rnd.randint(24, 90)))
        at = rnd.randint(0, len(text))
        while at < len(text) and text[at] != " ":
            at += 1
        head = text[:at] + rnd.choice([" private key ", " Authorization Bearer ", " credential "])
        yield head + secret + text[at:], len(head), len(head) + len(secret), secret


def test_random_strings_are_reported_and_words_are_not(spark):
    text, words = prose(400)
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    dictionary = S.identifiers(docs)
    assert 0 < len(dictionary) <= S.DICTIONARY_BYTES
    caught = [any((f["start"], f["end"]) == (a, b) for f in S.scan(t, dictionary)) for t, a, b, _ in planted()]
    assert sum(caught) >= 0.95 * len(caught)
    rnd = random.Random(9)
    for joint in ("_", ".", "/"):
        name = joint.join(rnd.choices([w for w in words if len(w) > 3], k=5))
        assert S.scan(f"{text[:300]} private key {name} {text[300:600]}", dictionary) == []


def test_repeated_and_covered_strings():
    text, _ = prose(100)
    secret = "Zq3vX8LmT0aBc9RkWd71YhUe"
    twice = f"{text} private key {secret} and private key {secret} {text}"
    assert len(S.scan(twice, b"")) == 2
    assert [f["kind"] for f in S.scan(f"token = {secret}", b"")] == ["assign"]
    partly = "private key QzX9pLmW0123456789abcdefTTqVbNYu"
    assert [f["kind"] for f in S.scan(partly, b"")] == ["novel", "hex"]


def test_strings_far_from_secrecy_are_left():
    assert S.scan("a commit " + "x " * 40 + "Zq3vX8LmT0aBc9RkWd71YhUe", b"") == []


def test_odd_tables(spark):
    long = "word " * 200_000 + "private key Zq3vX8LmT0aBc9RkWd71YhUe"
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "token = abcdefghijkl", 7), (3, long, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings int")
    got = [(r["doc_id"], len(r["findings"])) for r in S.with_findings(docs, S.identifiers(docs)).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 1), (3, 1), (None, 0)]
    empty = docs.limit(0)
    assert S.identifiers(empty) == b"" and S.with_findings(empty, b"").collect() == []


@pytest.mark.parametrize("size", [40, 5000])
def test_long_strings_are_measured_whole(size):
    rnd = random.Random(size)
    secret = "".join(rnd.choices(string.ascii_letters + string.digits, k=size))
    text = f"bearer {secret}"
    assert [(f["start"], f["end"]) for f in S.scan(text, b"")] == [(7, 7 + size)]


def test_query_equals_the_scan(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dictionary = S.identifiers(docs)
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base(text))
        want[r["doc_id"]] = (hashlib.sha256(spans.encode()).hexdigest(), ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in S.scan(text, dictionary)))
    got = {r["doc_id"]: (r["base_sha256"], r["spans"]) for r in QUERIES["op13_secret_scan"](spark, sf).collect()}
    assert got == want
