import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beatloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    w, hit, found = WORD.findall(low(text)), set(), set()
    for item, phrase in items:
        p = WORD.findall(low(phrase))
        for k in range(max(1, len(p) - 9)) if p else ():
            x = p[k : k + 10]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcé .A0", max_size=60), max_size=6), st.lists(st.text(alphabet="abcé .A", max_size=30), min_size=1, max_size=4))
def test_hits(texts, phrases):
    items = list(enumerate(phrases))
    got = dc.Phrases.of(items).hits([t.encode() for t in texts])
    want = [brute(t, items) for t in texts]
    assert [(n, sum(b - a + 1 for a, b, *_ in spans), found) for n, spans, found in got] == want


def test_wavelet_and_locate():
    rng = dc.np.random.default_rng(1)
    symbols = rng.integers(0, 5, 400)
    symbols[0] = 0
    w = dc.Wavelet(symbols, 3)
    at = dc.np.arange(401)
    for s in range(5):
        assert (w.rank(dc.np.full(401, s), at) == dc.np.concatenate(([0], dc.np.cumsum(symbols == s)))).all()
    assert (w[dc.np.arange(400)] == symbols).all()
    index = dc.FMIndex(symbols, 4)
    windows = dc.np.array([[1, 2], [3, -1], [4, 4]])
    for k, a, b in zip(*index.search(windows, dc.np.array([2, 1, 2]))):
        p = [x for x in windows[k] if x >= 0]
        want = [i for i in range(400) if list(symbols[i : i + len(p)]) == p]
        assert sorted(index.locate(dc.np.arange(a, b))) == want


def rows():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30)))) for k in range(12)] + [(None, "null item here"), (3, "w1 w2 w3"), (50, None), (51, "!!")]
    docs = [(k, " ".join(rng.choice(vocab + ["Zz", "É"]) for _ in range(50)) + ". " + rng.choice(items[:12])[1].upper() + " tail") for k in range(40)]
    return docs + [(None, None), (1, ""), (1, ""), (60, "w1 " * 30_000), (61, "a null ITEM, here")], items


@pytest.mark.parametrize("block", [dc.PHRASE_BYTES, 100])
def test_frames_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "PHRASE_BYTES", block)
    data, items = rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find(docs, bench, out="_found").collect()
    assert len(found) == len(data)
    for r in found:
        f = r["_found"]
        assert (f["n_words"], f["n_hit"], sorted(f["items"])) == brute(r["text"], items) and r["hits"] == "x"
        raw = (r["text"] or "").encode()
        for s in f["spans"]:
            assert len(WORD.findall(low(raw[s["start"] : s["end"]].decode()))) == s["last"] - s["first"] + 1
    assert dc.find(docs.limit(0), bench, out="_found").count() == 0
    assert {r["_found"]["n_hit"] for r in dc.find(docs, bench.limit(0), out="_found").collect()} == {0}


def test_clean(spark):
    bench = spark.createDataFrame([(1, "uno dos tres")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é Uno, dos: tres! fin uno dos tres", 9, "k"), (2, "uno dos", 7, "k"), (None, None, None, None)],
                                 "doc_id long, text string, n_chars long, hits string")
    got = {r["doc_id"]: tuple(r) for r in dc.clean(docs, bench).collect()}
    assert got[1] == (1, "é ! fin ", 8, "k") and got[2] == (2, "uno dos", 7, "k") and got[None] == (None,) * 4


def test_blocks_are_searched_in_the_workers(spark, monkeypatch):
    monkeypatch.setattr(dc, "PHRASE_BYTES", 100)
    data, items = rows()
    for name in ("of", "made"):  # no block is made on the driver
        monkeypatch.setattr(dc.Phrases, name, None)
    docs = spark.createDataFrame(data + data[:3], "doc_id long, text string")
    got = dc.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        assert (r["hits"]["n_words"], r["hits"]["n_hit"], sorted(r["hits"]["items"])) == brute(r["text"], items)
    assert len(got) == len(data) + 3


def test_long_item_in_pieces_and_text_under_many_ids(spark, monkeypatch):
    monkeypatch.setattr(dc, "PHRASE_BYTES", 5000)
    rng = random.Random(9)
    long = [f"v{rng.randrange(300)}" for _ in range(2 * dc.PIECE + 500)]
    shared = "one passage that stands under very many item ids at once here"
    items = [("long", " ".join(long)), ("long", " ".join(long))] + [(f"i{k}", shared) for k in range(20_000)]
    cut = [" ".join(long[k : k + 12]) for k in (0, dc.PIECE - 6, dc.PIECE, 2 * dc.PIECE - 11, len(long) - 12)]
    data = [(k, f"Before, {c.upper()}. After") for k, c in enumerate(cut)] + [(9, " ".join(long)), (10, shared), (11, f"x {shared} {cut[1]}"), (12, "v1 v2 v3")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 100)
    got = {r["doc_id"]: r for r in dc.find(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), bench).collect()}
    ids = sorted(f"i{k}" for k in range(20_000))
    for k in range(5):
        assert got[k]["hits"]["n_hit"] == 12 and got[k]["hits"]["items"] == ["long"]
    assert got[9]["hits"]["n_hit"] == len(long) and got[10]["hits"]["items"] == ids and got[10]["hits"]["n_hit"] == 12
    assert got[11]["hits"]["items"] == [*ids, "long"] and [s["last"] - s["first"] for s in got[11]["hits"]["spans"]] == [23]
    assert got[12]["hits"]["n_hit"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé .A0", max_size=60), max_size=6), st.lists(st.text(alphabet="abcé .A", max_size=30), min_size=2, max_size=6))
def test_hits_of_several_blocks_in_one_index(texts, phrases):
    items = list(enumerate(phrases))
    blocks = [dc.Phrases.of(items[k::2]) for k in range(2)]
    shard = dc.Shard([t.encode() for t in texts], *dc.vocabulary(blocks))
    for b in blocks:
        shard.search(b)
    assert [(n, sum(b - a + 1 for a, b, *_ in spans), sorted(found)) for n, spans, found in shard.hits()] == [brute(t, items) for t in texts]
