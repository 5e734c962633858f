import zlib

import numpy as np
import pytest

from beatloom.llm import sharding
from beatloom.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_536, 65_537])
def test_permutation(n):
    p = sharding.Feistel(n)
    out = p.forward(np.arange(n))
    assert sorted(out) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()


def test_keys_change_the_order():
    a, b = sharding.Feistel(1000).forward(np.arange(1000)), sharding.Feistel(1000, (1, 2, 3, 4)).forward(np.arange(1000))
    assert (a != b).mean() > 0.9


def test_frames(spark):
    rows = [(5, "x"), (None, None), (5, "x"), (None, "é"), (1, "")] + [(k, "t") for k in range(100, 195)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shuffle_to_shards(docs, 8).collect()
    again = sharding.shuffle_to_shards(docs.repartition(3), 8).collect()
    plain = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["shard"], r["slot"]) for r in rs)
    assert plain(got) == plain(again) and len(got) == 100
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sharding.shuffle_to_shards(docs.limit(0), 8).count() == 0


def test_query_places_follow_from_row_numbers(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    order = sorted((d, len(t) + 1, zlib.crc32(t)) for d, t in docs)
    places = sharding.Feistel(len(order)).forward(np.arange(len(order)))
    want = {(d, size, crc, "rows", int(p % 8), int(p // 8)) for (d, size, crc), p in zip(order, places)}
    got = QUERIES["op7_sharding"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r)[:6] for r in got} == want and all(r["grown_shard"] is None for r in got)
