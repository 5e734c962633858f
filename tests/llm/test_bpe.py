import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from beatloom.llm import bpe
from beatloom.llm.queries import byte_bpe

TOKENIZER = byte_bpe()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TOKENIZER.codec().rank,
                            special_tokens={})
TEXTS = ["", None, "a", "Hello world's  end\n\n x", "é" * 700, "ab" * 3000, "aaaa" * 1000, "=" * 2000, "\U0001f600 <|endoftext|>",
         " \t\n ", "x" * 1024, "日本語のテキスト", "1234567890" * 40]


def test_equals_library():
    got = TOKENIZER.codec().encode(TEXTS)
    assert [g.tolist() for g in got] == [LIBRARY.encode_ordinary(t or "") for t in TEXTS]
    assert [TOKENIZER.codec().decode(g) for g in got] == [(t or "").encode() for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [g.tolist() for g in TOKENIZER.codec().encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_pair_table_full_of_collisions():
    a, b = np.divmod(np.arange(3000, dtype=np.int32), 60)
    table = bpe.PairTable(a.astype(np.int32), b.astype(np.int32), np.arange(3000, dtype=np.int32))
    assert (table(a.astype(np.int32), b.astype(np.int32)) == np.arange(3000)).all()
    assert (table(np.array([60, -1], np.int32), np.array([0, 3], np.int32)) == bpe.NONE).all()


def test_frames(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string")
    out = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()
    assert len(out) == len(rows) and all(r["token"] == "kept" for r in out)
    for r in out:
        assert r["ids"] == LIBRARY.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode()
    assert bpe.encode(docs.limit(0), TOKENIZER).count() == 0


def test_query(spark):
    from beatloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d["text"] or "")
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
