"""Exact deduplication by a stream with disk-backed state.

Files of documents arrive as a stream. RocksDB keeps, without expiry, one entry per digest of a text: how often it
came, the largest id with it, and where that row's content lies (file and row). Each batch is combined by digest before the
shuffle, so a text that a third of all rows hold is a few rows there. Digests alone prove nothing: the texts of all hits are
compared, byte by byte, with the text that the locator of their class leads to; digests that different texts share are told
apart by the texts themselves.

Results in odd cases:

* a null text counts as empty; no other text is changed;
* null ids come before all others, so such a row stays only if no other of its text has an id;
* of rows that are equal in text and id, the one stored last (by file and row) stays;
* an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class DedupConfig:
    #: Input of one micro-batch, at least one file; None: as much as all cores scan in so many waves of tasks.
    batch_bytes: int | None = None
    waves: int = 4
    #: Rows of one class that are compared with, or told of, their kept row in one group.
    salted: int = 256
    #: Classes of several rows are broadcast to prune texts if they are counted and no more than this.
    few_classes: int = 100_000
    #: Failed runs of the stream are started again from its checkpoint so many times.
    restarts: int = 2
    #: A digest of a text in bytes.
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(doc_id, digest, file, row, text): rows with the place where their content lies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", cfg.digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text.alias("text"))


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """doc_id and text, as they are stored."""
    return spark.read.parquet(path).select("doc_id", "text").schema


@contextmanager
def _conf(spark: SparkSession, **wanted: str):
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StreamingDeduplicator:
    """State of all texts that came so far, kept below `folder`; advance() takes what has come since.

    A restart reads the state of the checkpoint, so rows are counted once, however often a run is lost.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, cfg: DedupConfig | None = None):
        self.spark, self.path, self.folder, self.cfg = spark, path.rstrip("/"), folder.rstrip("/"), cfg or DedupConfig()

    def _batch_bytes(self) -> int:
        size = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(self.spark.conf.get("spark.sql.files.maxPartitionBytes"))
        return self.cfg.batch_bytes or size * self.spark.sparkContext.defaultParallelism * self.cfg.waves

    def advance(self) -> None:
        """Runs the stream over all files that are there and ends."""
        # A pattern that fits the path alone: the streaming reader takes a single file only through one.
        source = self.spark.readStream.schema(_schema(self.spark, self.path)).option("maxBytesPerTrigger", self._batch_bytes())
        rows = _located(source.parquet(f"{self.path[:-1]}[{self.path[-1]}]"), self.cfg)
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("best"))

        def log(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        for attempt in range(self.cfg.restarts + 1):
            with _conf(self.spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true", spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false", spark__sql__streaming__noDataMicroBatches__enabled="false"):
                query = state.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                return
            except Exception:
                if attempt == self.cfg.restarts:
                    raise

    def classes(self) -> DataFrame:
        """(digest, n, best): the last state of every digest."""
        changes = self.spark.read.schema("digest binary, n long, best struct<doc_id: long, file: string, row: long>, batch long").parquet(f"{self.folder}/changes")
        return changes.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("last")).select("digest", "last.*")

    def _rows(self) -> DataFrame:
        return _located(self.spark.read.schema(_schema(self.spark, self.path)).parquet(self.path), self.cfg)

    def _salted(self, classes: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
        """Functions that add `salt` to rows with a digest, and that repeat rows with an n for every salt: large classes are many keys.

        Classes of over a thousandth of all rows are fewer than a thousand and are broadcast to salt their rows.
        """
        counted = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
        large = max(4 * self.cfg.salted, counted // 1000)
        parts = F.when(F.col("n") > large, F.ceil(F.col("n") / self.cfg.salted)).otherwise(F.lit(1).cast("long"))
        hot = classes.where(F.col("n") > large).select("digest", parts.alias("parts"))

        def salt(rows: DataFrame) -> DataFrame:
            salted = rows.join(F.broadcast(hot), "digest", "left")
            return salted.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.coalesce("parts", F.lit(1)))).drop("parts")

        return salt, lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))

    def collisions(self, repeated: DataFrame) -> DataFrame:
        """(digest): digests under which the text of a row is not that of the row which the state points to.

        repeated: classes of several rows. The kept texts are found by their locators, one row a class.
        """
        few, rows = repeated.limit(self.cfg.few_classes + 1).count() <= self.cfg.few_classes, self._rows()
        side = F.broadcast if few else lambda df: df
        at = repeated.select("digest", "n", F.col("best.file").alias("file"), F.col("best.row").alias("row"))
        kept = rows.drop("digest", "doc_id").join(side(at), ["file", "row"]).select("digest", "n", F.col("text").alias("kept_text"))
        salt, spread = self._salted(repeated)
        hits = salt(rows.join(side(at.select("digest")), "digest", "left_semi"))
        return hits.join(spread(kept), ["digest", "salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct()

    def result(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the files."""
        classes, _ = common.materialize(self.spark, self.classes(), "dedup-classes")
        repeated = classes.where("n > 1")
        apart, _ = common.materialize(self.spark, self.collisions(repeated), "dedup-collisions")
        rows = self._rows().withColumn("text_sha256", F.sha2("text", 256))
        shared = not apart.isEmpty()
        plain = rows.join(apart, "digest", "left_anti") if shared else rows
        salt, spread = self._salted(repeated)
        joined = salt(plain.drop("text")).join(spread(repeated), ["digest", "salt"], "left")
        here = F.struct("doc_id", "file", "row")
        alone = F.col("n").isNull()
        out = joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (alone | here.eqNullSafe(F.col("best"))).alias("kept"), "text_sha256")
        if not shared:
            return out
        mixed = rows.join(apart, "digest", "left_semi")
        exact = mixed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(here).alias("best"))
        told = mixed.join(exact, ["digest", "text"])
        return out.unionByName(told.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), here.eqNullSafe(F.col("best")).alias("kept"), "text_sha256"))


def deduplicated(spark: SparkSession, path: str, cfg: DedupConfig | None = None) -> DataFrame:
    """One run over the files of `path`, with a state of its own in the shared folder."""
    stream = StreamingDeduplicator(spark, path, common.scratch(spark, "dedup"), cfg)
    stream.advance()
    return stream.result()


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each text stays."""
    return deduplicated(spark, f"{sf_dir}/documents.parquet")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
