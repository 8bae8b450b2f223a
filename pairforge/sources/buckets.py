"""A keyed table in buckets: a write replaces rows by key and rewrites the buckets that it touches, no others."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.validate import InvalidData
from pairforge.shared import literal


class Superseded(InvalidData):
    """Another writer committed first; nothing of this write is left."""


class KeyedTable:
    """A Parquet table with one row per key, in buckets by the key's hash.

    A version is a manifest that names, for each bucket, the write whose files hold it. put() reads and writes the touched buckets
    alone, into a folder of its own, and then renames its manifest to the next number: a reader sees the old or the new
    version, and of two writers that began with the same version the second one's rename fails. Files that no
    kept version names are removed. A missing table reads as empty. Renaming must not replace a file that exists, as on HDFS.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets, self.keep = buckets, keep
        self.columns = [c.split()[0] for c in schema.split(", ")]
        if "bucket" in (c.lower() for c in self.columns):
            raise InvalidData("a keyed table has no column of the name bucket")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Numbers of the committed versions that are kept, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.removesuffix(".json").isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def _current(self) -> tuple[int, dict]:
        versions = self.versions()
        return (versions[-1], self._manifest(versions[-1])) if versions else (0, {"buckets": self.buckets, "at": {}})

    def _files(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{manifest['at'][b]}/bucket={b}" for b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else literal(self.spark, [], self.schema)

    def read(self) -> DataFrame:
        manifest = self._current()[1]
        return self._files(manifest, sorted(manifest["at"], key=int))

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Replaces by key; of rows with one key the greatest by `order` stays, or by all columns if none is named."""
        began, manifest = self._current()
        rest = [c for c in self.columns if c not in self.keys]
        row = F.struct(*self.columns)
        last = rows.groupBy(*(F.col(k).alias(k) for k in self.keys)).agg(F.max_by(row, F.struct(order, *rest) if order else F.struct(*(rest or self.keys))).alias("row")).select("row.*")
        dealt = F.pmod(F.xxhash64(*self.keys), F.lit(manifest["buckets"])).cast("int")
        new = last.withColumn("bucket", dealt)
        touched = [str(r[0]) for r in rows.select(dealt.alias("bucket")).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        write = uuid.uuid4().hex
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        old = self._files(manifest, [b for b in touched if b in manifest["at"]]).alias("o").join(new.select(*self.keys).alias("n"), same, "left_anti")
        old.withColumn("bucket", dealt).unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        try:
            self._commit(began + 1, {"buckets": manifest["buckets"], "at": manifest["at"] | dict.fromkeys(touched, write)}, write)
        except Superseded:
            self._remove(f"{self.path}/data/{write}")
            raise
        self.vacuum()

    def _commit(self, version: int, manifest: dict, write: str) -> None:
        """The manifest under a name of its own first, then renamed to the version's number, which must be free."""
        fs, draft = self._hadoop(f"{self.path}/versions/{write}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(hadoop, "Options$Rename")
        keep = self.spark.sparkContext._gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._hadoop(f"{self.path}/versions/{version}.json")[1]), keep)
        except Py4JJavaError as failure:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
                raise Superseded(f"version {version} of {self.path} has been written by another") from None
            raise

    def _remove(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def vacuum(self) -> None:
        """Removes versions beyond the last `keep`, and buckets of older writes that no kept version names.

        What is newer than the last version, such as a write that is under way, stays.
        """
        versions = self.versions()
        kept = {v: self._manifest(v) for v in versions[-self.keep :]}
        gone = {v: self._manifest(v) for v in versions[: -self.keep]}
        named = lambda manifests: {(w, b) for m in manifests for b, w in m["at"].items()}
        used = named(kept.values())
        for write, bucket in named(gone.values()) - used:
            self._remove(f"{self.path}/data/{write}/bucket={bucket}")
        for v in gone:
            self._remove(f"{self.path}/versions/{v}.json")
        for write in {w for w, _ in named(gone.values())} - {w for w, _ in used}:
            self._remove(f"{self.path}/data/{write}")

    def matching(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select(*self.keys), self.keys, "left_semi")
