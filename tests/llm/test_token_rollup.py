from collections import Counter

import pytest
from pyspark.sql import functions as F

from beatloom.llm import token_rollup as tr
from beatloom.llm.queries import QUERIES, byte_bpe


def test_signed_batches(spark, tmp_path):
    rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    new = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", None)], "source string, lang string, version string, tokens long")
    assert rollup.commit("1", tr.inserts(new)) and not rollup.commit("1", tr.inserts(new))
    change = spark.createDataFrame([("b", "en", "v2", 9, "a", "en", "v1", 7)],
                                   "source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long")
    assert rollup.commit("2", tr.revisions(change))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 1, 5), ("b", "en", "v2", 1, 9), (None, None, "v1", 1, 0)}
    assert rollup.commit("3", tr.deletes(new.limit(0))) and not rollup.commit("2", tr.revisions(change))
    gone = spark.createDataFrame([("a", "en", "v1", 5), (None, None, "v1", 0)], new.schema)
    assert rollup.commit("4", tr.deletes(gone))
    assert [tuple(r) for r in rollup.totals().collect()] == [("b", "en", "v2", 1, 9)]


def test_half_written_commit_is_ignored(spark, tmp_path):
    rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
    rows = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, version string, tokens long")
    rollup.commit("1", tr.inserts(rows))
    (tmp_path / "rollup" / "00000002").mkdir()
    assert [tuple(r) for r in tr.Rollup(spark, rollup.path).totals().collect()] == [("a", "en", "v1", 1, 5)]
    assert rollup.commit("2", tr.inserts(rows)) and [r["n_tokens"] for r in rollup.totals().collect()] == [10]


def test_totals_are_written_in_several_tasks(spark, tmp_path):
    keys = [f"spark.sql.{k}" for k in ("adaptive.coalescePartitions.enabled", "shuffle.partitions")]
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("false", "4")):
            spark.conf.set(k, v)
        rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
        rows = spark.createDataFrame([(f"host {k}", "en", "v1", k) for k in range(200)], "source string, lang string, version string, tokens long")
        assert rollup.commit("1", tr.inserts(rows)) and not rollup.commit("1", tr.inserts(rows)) and rollup.commit("2", tr.inserts(rows))
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    got = rollup.totals()
    assert got.select(F.input_file_name()).distinct().count() > 1
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in got.collect()} == {(f"host {k}", 2, 2 * k) for k in range(200)}
    assert got.count() == 200


ROWS = "source string, lang string, version string, tokens long"


def test_success_markers_play_no_part(spark, tmp_path):
    conf, key = spark._jsc.hadoopConfiguration(), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    old = conf.get(key)
    conf.set(key, "false")
    try:
        rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
        rows = spark.createDataFrame([("a", "en", "v1", 5)], ROWS)
        assert rollup.commit("1", tr.inserts(rows)) and rollup.commit("2", tr.inserts(rows)) and not rollup.commit("1", tr.inserts(rows))
        assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 10)]
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def test_one_of_two_committers_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 5)], ROWS)
    other = tr.Rollup(spark, str(tmp_path / "rollup"))

    class Overtaken(tr.Rollup):
        def _publish(self, number, batch, totals):
            other.commit("first", tr.inserts(rows))
            super()._publish(number, batch, totals)

    slow = Overtaken(spark, other.path)
    with pytest.raises(tr.Conflict):
        slow.commit("second", tr.inserts(rows))
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 1, 5)]
    assert tr.Rollup(spark, other.path).commit("second", tr.inserts(rows))
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 2, 10)]


def test_old_totals_are_removed_and_batches_remembered(spark, tmp_path):
    rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
    rows = spark.createDataFrame([("a", "en", "v1", 1)], ROWS)
    for k in range(6):
        assert rollup.commit(f"b{k}", tr.inserts(rows))
    assert len(list((tmp_path / "rollup").glob("totals-*"))) == tr.KEEP
    assert not any(rollup.commit(f"b{k}", tr.inserts(rows)) for k in range(6))
    assert [r["n_tokens"] for r in rollup.totals().collect()] == [6]


def test_clashing_columns(spark, tmp_path):
    rollup = tr.Rollup(spark, str(tmp_path / "rollup"))
    rows = spark.createDataFrame([("a", "en", "v1", 5, "x", 3, 4)], ROWS + ", batch string, n_docs int, r int")
    assert rollup.commit("1", tr.inserts(rows)) and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 5)]


def test_query(spark):
    sf, codec = "/root/testdata/sf0.001", byte_bpe().codec()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    want = Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if d["doc_id"] not in toxic:
            text = "\n".join(dict.fromkeys((d["text"] or "").split("\n")))
            for version, n in (("byte_bpe_50k", len(codec.encode([text])[0])), ("words_1", len(text.split()))):
                want[d["source"], d["lang"], version, "docs"] += 1
                want[d["source"], d["lang"], version, "tokens"] += n
    got = Counter()
    for r in QUERIES["op2_token_rollup"](spark, sf).collect():
        got[r["source"], r["lang"], r["version"], "docs"] = r["n_docs"]
        got[r["source"], r["lang"], r["version"], "tokens"] = r["n_tokens"]
    assert got == want
