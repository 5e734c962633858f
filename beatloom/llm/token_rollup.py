"""Token counts kept as delta-maintained rollups.

Changes to the corpus come in batches of inserts, deletes and revisions with
their counts before and after.  Each becomes one or two signed rows; a batch
is their sum by (source, lang, version), added to the totals of the batches
before it.  A commit writes the new totals into a folder of their own, then
publishes them by renaming a manifest, which names the batch and that folder,
to the next number; the rename fails if another committer took the number, so
one of two at once gets ``Conflict`` and may commit again.  A batch committed
again changes nothing; totals without a manifest were never committed; success
markers of the output committer play no part.  A manifest is one small file a
commit; totals older than the last ``KEEP`` commits are removed.

The rename must be atomic, as in HDFS; on object stores without that, commit
from one place at a time.

Null source, lang or version are groups of their own; null counts are 0;
groups that come to no documents and no tokens are left out; an empty batch is
committed like any other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.store import fresh_folder

KEY = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
KEEP = 3


class Conflict(RuntimeError):
    """Another committer took the number; nothing was changed."""


def _row(sign: int, prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{k}").cast("string").alias(k) for k in KEY], F.lit(sign).cast("long").alias("n_docs"),
                    (sign * F.coalesce(F.col(f"{prefix}tokens"), F.lit(0))).cast("long").alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows of new documents: source, lang, version, tokens."""
    return rows.select(_row(1, "").alias("r")).select("r.*")


def deletes(rows: DataFrame) -> DataFrame:
    """Signed rows of documents that go, with the counts they came with."""
    return rows.select(_row(-1, "").alias("r")).select("r.*")


def revisions(rows: DataFrame) -> DataFrame:
    """Signed rows of documents whose count or key changes: the old key and
    count are prefixed ``old_``."""
    return rows.select(F.explode(F.array(_row(-1, "old_"), _row(1, ""))).alias("r")).select("r.*")


@dataclass
class Rollup:
    """Totals in a folder: ``commits`` holds one manifest a commit, the highest
    number names the totals that hold."""

    spark: SparkSession
    path: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> "Rollup":
        return cls(spark, fresh_folder(spark, "rollup"))

    # -- files -------------------------------------------------------------
    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        fs, folder = self._files(), self._at("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("batch string, totals string").json(f"{self.path}/commits/*.json")

    def _latest(self) -> tuple[int, DataFrame]:
        done = self._commits()
        if not done:
            return 0, self.spark.createDataFrame([], SCHEMA)
        named = self.spark.read.schema("batch string, totals string").json(f"{self.path}/commits/{done[-1]:08d}.json").first()
        return done[-1], self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{named['totals']}")

    def _publish(self, number: int, batch: str, totals: str) -> None:
        jvm, fs = self.spark._jvm, self._files()
        draft, final = self._at("commits", f"_{uuid.uuid4().hex}"), self._at("commits", f"{number:08d}.json")
        out = fs.create(draft, False)
        try:
            out.write(json.dumps({"batch": batch, "totals": totals}).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_overwrite)
        except Py4JJavaError as err:
            fs.delete(draft, False)
            fs.delete(self._at(totals), True)
            if "FileAlreadyExistsException" in str(err.java_exception):
                raise Conflict(f"commit {number} was taken while {batch!r} was written") from None
            raise

    def _forget(self, number: int) -> None:
        """Remove the totals of the commit that fell out of the last ``KEEP``."""
        if number > 0 and number in self._commits():
            named = self.spark.read.schema("batch string, totals string").json(f"{self.path}/commits/{number:08d}.json").first()
            self._files().delete(self._at(named["totals"]), True)

    # -- batches -----------------------------------------------------------
    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False if it was committed before."""
        last, state = self._latest()
        if last and not self._manifests().where(F.col("batch") == batch).isEmpty():
            return False
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens")]
        # The batch is summed first: its rows are many, the totals few.
        both = state.unionByName(signed.groupBy(*KEY).agg(*sums))
        totals = both.groupBy(*KEY).agg(*sums).where("n_docs <> 0 or n_tokens <> 0")
        folder = f"totals-{uuid.uuid4().hex}"
        totals.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{self.path}/{folder}")
        self._publish(last + 1, batch, folder)
        self._forget(last + 1 - KEEP)
        return True

    def totals(self) -> DataFrame:
        return self._latest()[1]
