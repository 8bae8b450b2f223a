"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last keep the columns of documents, and any others that are there, whatever their names; an
empty table stays empty. A null text counts as empty and a null id is an id like others, but bears no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import common, order_minhash, ordinal_tox, packing, secrets


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, rejects go.

    Repeated rows are each judged, alike; empty texts stay, and without toxic labels every document does.
    """
    cfg = ordinal_tox.ToxicityConfig()
    model = ordinal_tox.fit_toxicity(docs, ordinal_tox.toxic_labels(spark, sf_dir), cfg)
    return ordinal_tox.drop_toxic(docs, model, cfg)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Empty texts are one class. A null id comes last; where several texts of a class tie in id, one of them stays,
    chosen by its hash, and of repeated rows one.
    """
    return order_minhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, plain or encoded, are cut out of the texts; every document stays, a null text as null."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, ready for training. A small store of words, as executors are full by now.

    An empty text is the end's id alone; rows with one id are each packed.
    """
    return packing.pack_documents(docs, cfg=packing.PackConfig(store_words=150_000))


STAGES = [("toxicity", drop_toxic), ("near_dedup", deduplicate), ("secrets", redact), ("packing", pack)]

#: No SQL: the stages fit a model, align texts and run tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = common.materialize(spark, docs, f"stage-{name}")
    return docs
