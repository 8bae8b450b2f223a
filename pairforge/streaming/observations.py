"""Extension: observations that arrive as a stream, kept once per trial and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.schema import OBSERVATION
from pairforge.sources.buckets import KeyedTable


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(OBSERVATION).json(folder)


def deduplicated(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows once per trial and cell, as long as repeats come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["trial_id", "cell_id"])


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """Every batch replaces rows of the table by key; running a batch again changes nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: table.put(rows)).option("checkpointLocation", checkpoint).start()
