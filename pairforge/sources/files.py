"""Readers and writers: strict JSON lines, YAML banks, key-value tables, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.text import cell_id
from pairforge.operators.checks import Rule, checked, observation_rules
from pairforge.operators.validate import InvalidData, pair_violations, repeated, repeated_instructions, require_empty
from pairforge.schema import OBSERVATION, OPTIONAL, PAIRS
from pairforge.shared import literal, scratch


def _kinds(schema: T.StructType, optional: tuple[str, ...]) -> dict[str, set[str]]:
    names = {T.StringType: "STRING", T.IntegerType: "BIGINT", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN"}
    return {f.name: {names[type(f.dataType)]} | ({"VOID"} if f.name in optional else set()) for f in schema}


def _strict_lines(spark: SparkSession, paths: list[str], schema: T.StructType, optional: tuple[str, ...]) -> DataFrame:
    """(file, value, fits, r): the lines that are not blank, whether each has exactly the schema's fields and types, and its row.

    Spark's reader drops unknown fields, so the keys and the types of each line are looked at, too.
    """
    lines = spark.read.text(paths).where(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    lines = lines.withColumn("v", F.try_parse_json("value"))
    kinds = _kinds(schema, optional)
    fields = F.sort_array(F.json_object_keys("value"))
    ok = F.coalesce(fields == F.array(*map(F.lit, sorted(kinds))), F.lit(False))
    for name, allowed in kinds.items():
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        ok = ok & F.coalesce(kind, F.lit("VOID")).isin(*allowed)
    return lines.select("file", "value", ok.alias("fits"), F.from_json("value", schema).alias("r"))


def read_strict(spark: SparkSession, paths: list[str], schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines with exactly the schema's fields and types; blank lines are skipped, others fail, before anything is read."""
    lines = _strict_lines(spark, paths, schema, optional)
    require_empty(lines.where(~F.col("fits")).select("file", "value"), "lines that do not match the schema")
    return lines.select("r.*")


def load_observations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Observations of one or more files, checked in the pass that stores them; there must be rows."""
    rows = _strict_lines(spark, paths, OBSERVATION, OPTIONAL).select("file", "value", "fits", "r.*")
    expected = cell_id(*(F.col(c) for c in ("instruction", "framing", "channel", "author", "assistant")))
    rules = [Rule("lines that do not match the schema", ~F.col("fits")), *observation_rules(expected)]
    return checked(rows, rules, "observations", ("file", "value"), OBSERVATION.fieldNames(), least=1)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines with every field; Spark's readers, and so load_observations, take compressed files as they are."""
    df.write.option("ignoreNullFields", "false").option("compression", compression).json(path)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A bank of instruction pairs from YAML; small, so read on the driver through Spark's reader."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()["value"]
    names = [c.split()[0] for c in PAIRS.split(", ")]
    rows = []
    for entry in yaml.safe_load(text)["pairs"]:
        entry = {"pair_id" if k == "id" else k: v for k, v in entry.items()}
        if set(entry) != set(names):
            raise InvalidData(f"fields of pair {entry.get('pair_id')}: {sorted(entry)}")
        rows.append(tuple(entry[n] for n in names))
    bank = literal(spark, rows, PAIRS)
    require_empty(repeated(bank, "pair_id"), "repeated pair ids")
    require_empty(repeated_instructions(bank), "repeated instructions")
    require_empty(pair_violations(bank).select("pair_id"), "invalid pairs")
    return bank


def load_studies(spark: SparkSession, path: str) -> DataFrame:
    """Studies from a YAML list or single study."""
    import yaml

    from pairforge.schema import STUDIES

    loaded = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])
    entries = loaded if isinstance(loaded, list) else loaded.get("studies", [loaded])
    rows = []
    for e in entries:
        inputs = [tuple(str(i[c]) for c in ("instruction", "framing", "channel", "author")) for i in e["inputs"]]
        rows.append((study_fingerprint(e), e["assistant"], int(e.get("rollouts_per_permutation", 1)), *inputs))
    studies = spark.createDataFrame(rows, STUDIES)
    require_empty(repeated(studies, "study_id"), "repeated studies")
    return studies


def study_fingerprint(study: dict) -> str:
    """12 hex digits of the SHA-256 of the study's canonical ASCII JSON."""
    import hashlib

    text = json.dumps(study, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def text_library(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, content) of a directory with one folder per instruction."""
    rows = spark.read.text(f"{path.rstrip('/')}/*/*.txt", wholetext=True).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+\.txt$", 1).alias("folder"), F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("name"), F.col("value").alias("content"))


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nothing at all for an empty table."""
    if df.isEmpty():
        return False
    df.write.option("header", True).csv(path)
    return True


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder per table that has rows."""
    return [name for name, df in tables.items() if write_csv(df, f"{folder.rstrip('/')}/{name}")]


def markdown(df: DataFrame, most: int = 20) -> str:
    """A table of at most `most` rows for a report."""
    cell = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect())])


def temporary(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)
