"""Readers and writers of saved probes, activations, verdicts, dialogues and collections; all fail closed."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.probes import decide
from pairforge.operators.suite import partitioned_dialogues
from pairforge.operators.validate import InvalidData, repeated, require_empty
from pairforge.shared import literal, materialize, ship
from pairforge.sources.buckets import KeyedTable
from pairforge.sources.files import read_strict

DOCUMENTS = "id string, text string"
DIALOGUES = "id string, split string, text string, response string"
PARTITION = "id string, split string, sha256 string"
VERDICT_KEYS = ("study_id", "permutation", "position")
VERDICTS = "study_id string, permutation int, position int, expectation string, channel string, probability double, complies boolean, issue string"


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _struct(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def load_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Neutral documents of JSON lines with exactly an id and a text; ids are unique and texts not blank."""
    rows = read_strict(spark, paths, _struct(DOCUMENTS))
    require_empty(repeated(rows, "id"), "repeated documents")
    require_empty(rows.where(F.trim("text") == "").select("id"), "documents without text")
    return rows


def load_dialogues(spark: SparkSession, path: str, partition_path: str, split: str) -> DataFrame:
    """Dialogues of one split, each checked against the frozen partition."""
    partition = read_strict(spark, [partition_path], _struct(PARTITION))
    require_empty(repeated(partition, "id"), "repeated ids of a partition")
    return partitioned_dialogues(read_strict(spark, [path], _struct(DIALOGUES)), partition, split)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, token, layer, activation) of .npy shards of shape tokens x layers x width."""
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.load(io.BytesIO(content), allow_pickle=False)
            if x.ndim != 3 or not np.isfinite(x).all():
                raise InvalidData(f"{shard}: not a finite array of tokens, layers and width")
            for a in range(0, x.shape[0], 4096):
                part = x[a : a + 4096].astype(np.float32)
                n, layers, width = part.shape
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(1, width)), pa.int32()), pa.array(part.ravel()))
                yield pa.record_batch([pa.array([shard] * (n * layers)), pa.array(np.repeat(np.arange(a, a + n), layers)), pa.array(np.tile(np.arange(layers), n).astype(np.int32)), values], names=["shard", "token", "layer", "activation"])


def _activation_files(folder: str):
    """Writes each batch of rows as a shard and its token lines; yields the files' names and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores

        fs, root = stores.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_pylist() for c in ("document", "role", "position", "layers")}
            out = io.BytesIO()
            np.save(out, np.array(columns.pop("layers"), np.float32))
            mark = hashlib.sha256(out.getvalue() + json.dumps(columns).encode()).hexdigest()[:32]
            lines = [json.dumps({"shard": f"{mark}.npy", "token": k} | dict(zip(columns, row, strict=True))) for k, row in enumerate(zip(*columns.values(), strict=True))]
            files = {f"{mark}.npy": out.getvalue(), f"tokens-{mark}.jsonl": "\n".join(lines).encode()}
            for name, content in files.items():
                with fs.open_output_stream(f"{root}/{name}") as sink:
                    sink.write(content)
            yield pa.record_batch([pa.array(list(files)), pa.array([hashlib.sha256(c).hexdigest() for c in files.values()])], names=["name", "sha256"])

    return run


def save_activations(rows: DataFrame, folder: str) -> None:
    """Rows (document, role, position, layers: an array of layers of equal width) as shards, token lines and a manifest.

    Every task writes its own files, named by their contents, so a task that runs twice leaves the same ones; the driver sees the
    files' names and digests alone.
    """
    spark = rows.sparkSession
    ship(spark)
    files, _ = materialize(spark, rows.mapInArrow(_activation_files(folder.rstrip("/")), "name string, sha256 string"), "activation-files")
    text = json.dumps({"files": {r["name"]: r["sha256"] for r in files.distinct().collect()}}, sort_keys=True)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/manifest.json")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def load_activations(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, token, document, role, position, layer, activation) of a folder with manifest.json, token lines and shards.

    The manifest names every file with its SHA-256; a file that is missing, changed or not named is an error, as is a
    token without a row. Shards are parsed where they are read; meant to be ingested once, to Parquet.
    """
    ship(spark)
    folder = folder.rstrip("/")
    named = json.loads(_read_text(spark, f"{folder}/manifest.json"))["files"]
    wanted = literal(spark, sorted(named.items()), "name string, sha256 string")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where("name <> 'manifest.json'")
    seen = files.select("name", F.sha2("content", 256).alias("found"))
    require_empty(wanted.join(seen, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("name"), "files that are not as the manifest says")
    tokens = read_strict(spark, [f"{folder}/tokens*.jsonl"], _struct("shard string, token bigint, document string, role string, position bigint"))
    rows = files.where(F.col("name").endswith(".npy")).select("name", "content").mapInArrow(_shard_rows, "shard string, token long, layer int, activation array<float>")
    out = rows.join(tokens, ["shard", "token"], "full")
    require_empty(out.where("activation IS NULL OR role IS NULL").select("shard", "token"), "tokens and activations that do not match")
    return out.select("shard", "token", "document", "role", "position", "layer", "activation")


def _fingerprint(layer: int, roles: list[str], weights: list[list[float]], config: dict) -> str:
    text = json.dumps({"layer": layer, "roles": roles, "weights": weights, "config": config}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def save_probe(spark: SparkSession, path: str, layer: int, roles: list[str], weights: np.ndarray, config: dict) -> str:
    """One row of Parquet: the weights of each role, their intercept last, and a fingerprint, which is returned."""
    rows = np.asarray(weights, float).tolist()
    mark = _fingerprint(layer, roles, rows, config)
    literal(spark, [(layer, roles, rows, json.dumps(config, sort_keys=True), mark)], "layer int, roles array<string>, weights array<array<double>>, config string, fingerprint string").write.mode("errorifexists").parquet(path)
    return mark


def load_probe(spark: SparkSession, path: str) -> dict:
    """A saved probe; one whose fingerprint is not that of its contents is an error."""
    rows = spark.read.parquet(path).limit(2).collect()
    if len(rows) != 1:
        raise InvalidData("a probe is one row")
    r = rows[0]
    found = {"layer": r["layer"], "roles": list(r["roles"]), "weights": [list(w) for w in r["weights"]], "config": json.loads(r["config"])}
    if _fingerprint(**found) != r["fingerprint"]:
        raise InvalidData("the probe does not match its fingerprint")
    return found | {"weights": np.array(found["weights"]), "fingerprint": r["fingerprint"]}


class VerdictCache:
    """Saved probe verdicts; a read decides them again from their probabilities and fails where that differs."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, by_channel: DataFrame | None = None):
        self.table = KeyedTable(spark, path, VERDICTS, list(VERDICT_KEYS))
        self.threshold, self.by_channel = threshold, by_channel

    def put(self, rows: DataFrame) -> None:
        """rows: the keys, expectation, channel and probability."""
        self.table.put(decide(rows, self.threshold, self.by_channel).select(*(c.split()[0] for c in VERDICTS.split(", "))))

    def read(self) -> DataFrame:
        saved = self.table.read()
        again = decide(saved.withColumnsRenamed({"complies": "was", "issue": "said"}), self.threshold, self.by_channel)
        require_empty(again.where(~F.col("was").eqNullSafe(F.col("complies"))).select(*VERDICT_KEYS), "verdicts that differ from their probabilities")
        return saved


def saved_collections(spark: SparkSession, folder: str) -> DataFrame:
    """(study, folder, store) of a folder that holds study.yaml, or whose subfolders do; a store beside all is shared.

    No study, or one that is saved twice, is an error. Listed through Spark's file systems.
    """
    from pairforge.sources.files import study_fingerprint

    import yaml

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(folder.rstrip("/"))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise InvalidData(f"no folder {folder}")
    has = lambda path, name: fs.exists(hadoop(path, name))
    found = [root] if has(root, "study.yaml") else sorted((s.getPath() for s in fs.listStatus(root) if s.isDirectory() and has(s.getPath(), "study.yaml")), key=str)
    if not found:
        raise InvalidData(f"no study.yaml in {folder}")
    shared, rows = has(root, "collection"), []
    for path in map(str, (p.toString() for p in found)):
        study = study_fingerprint(yaml.safe_load(_read_text(spark, f"{path}/study.yaml")))
        rows.append((study, path, f"{root.toString() if shared else path}/collection"))
    out = literal(spark, rows, "study string, folder string, store string")
    require_empty(repeated(out, "study"), "studies that are saved twice")
    return out


def paired_texts(library: DataFrame, specs: DataFrame) -> DataFrame:
    """The text of every wanted (folder, name), each exactly once and not blank; texts that none wants are an error.

    library: folder, name, content; specs: folder, name.
    """
    both = specs.select("folder", "name").distinct().withColumn("wanted", F.lit(True)).join(library, ["folder", "name"], "full")
    require_empty(both.where("wanted IS NULL OR content IS NULL OR trim(content) = ''").select("folder", "name"), "texts without a specification, or the other way round")
    require_empty(repeated(library, "folder", "name"), "repeated texts")
    return both.select("folder", "name", "content")


def load_yaml_cache(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A YAML list of saved rows with exactly the schema's fields; of repeated keys the last stays. Small: read on the driver."""
    import yaml

    names, rows = [c.split()[0] for c in schema.split(", ")], {}
    for entry in yaml.safe_load(_read_text(spark, path)) or []:
        if set(entry) != set(names):
            raise InvalidData(f"fields of a saved row: {sorted(entry)}")
        rows[tuple(entry[k] for k in keys)] = tuple(entry[n] for n in names)
    return literal(spark, list(rows.values()), schema)


def write_suite(spark: SparkSession, studies: list[dict], path: str) -> None:
    """Studies as YAML with sorted keys, in one file of any file system that Spark knows."""
    import yaml

    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(yaml.safe_dump({"studies": studies}, sort_keys=True, allow_unicode=True).encode()))
    out.close()


def load_matchups(spark: SparkSession, path: str) -> DataFrame:
    """(assistant, input1, input2) of a YAML matchup or list of them; the inputs of one must differ."""
    import yaml

    from pairforge.schema import STUDIES

    loaded = yaml.safe_load(_read_text(spark, path))
    rows = []
    for e in loaded if isinstance(loaded, list) else [loaded]:
        if set(e) != {"assistant", "inputs"} or len(e["inputs"]) != 2 or any(set(i) != {"instruction", "framing", "channel", "author"} for i in e["inputs"]):
            raise InvalidData(f"fields of a matchup: {sorted(e)}")
        first, second = (tuple(str(i[c]) for c in ("instruction", "framing", "channel", "author")) for i in e["inputs"])
        if first == second:
            raise InvalidData("a matchup of equal inputs")
        rows.append(("", e["assistant"], 1, first, second))
    return spark.createDataFrame(rows, STUDIES).select("assistant", "input1", "input2")


def decode_saved(saved: DataFrame, expected: DataFrame, schema: str) -> DataFrame:
    """Saved payloads decoded, each checked to be of its trial's own matchup.

    saved: trial_id, payload (JSON with a `matchup` field); expected: trial_id, matchup (canonical JSON). A payload
    that cannot be read, or that is of another matchup or trial, is an error.
    """
    rows = saved.join(expected, "trial_id", "left").withColumn("v", F.from_json("payload", schema)).withColumn("of", F.get_json_object("payload", "$.matchup"))
    require_empty(rows.where("v IS NULL OR matchup IS NULL OR of IS NULL OR of <> matchup").select("trial_id"), "saved rows that are not of their trial")
    return rows.select("trial_id", "v.*")
