"""The pipeline against plain Python, stage by stage on each stage's input."""

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from beatloom.llm import suffix_dedup
from beatloom.llm.queries import SQL, byte_bpe
from tests.llm import test_decontaminate as plain_decontaminate
from tests.llm import test_near_duplicates as plain_near
from tests.llm import test_suffix_dedup as plain_suffix

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "quality rules":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
            want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op8_quality_rules']}) WHERE kept").fetchall()}
            assert set(after) == want and all(after[d]["text"] == before[d] for d in want)
        elif name == "MinHash near-dedup":
            rows = sorted(before.items())
            want = {d for (d, _), c in zip(rows, plain_near.brute(rows)) if d == c}
            assert set(after) == want
        elif name == "suffix-array dedup":
            for (d, t), spans in plain_suffix.brute(sorted(before.items())).items():
                data, at, kept = t.encode(), 0, b""
                for a, b in (suffix_dedup._inner(data, *s) for s in spans):
                    kept, at = kept + data[at:a], b
                text = (kept + data[at:]).decode()
                assert after[d]["text"] == text and after[d]["n_chars"] == len(text)
        elif name == "benchmark decontamination":
            assert set(after) == set(before)
            for d, t in before.items():
                n, hit, _ = plain_decontaminate.brute(t, bench)
                assert plain_decontaminate.brute(after[d]["text"], [])[0] == n - hit
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe().codec().rank, special_tokens={})
            assert {d: list(r["ids"]) for d, r in after.items()} == {d: library.encode_ordinary(t or "") for d, t in before.items()}


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 40_000, "en", "s", 80_000), (2, "x " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).count()
