"""Trial-shaped facts derived from the order tables, in Spark and in SQL.

The first two lines of an order make a trial: the order's priority is the pair, its status the
assistant, the lines are the two observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions.text import cell_id
from pairforge.shared import table

LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity")

OBS_SQL = """
obs_l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity) AS rn FROM lineitem),
obs_t AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM obs_l WHERE rn <= 2),
obs_s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, rn) AS sd FROM obs_t WHERE k = 2),
obs_raw AS (
  SELECT l_orderkey AS trial_id, CAST(rn AS INTEGER) AS position, o_orderstatus AS assistant, o_orderpriority AS pair_id,
         CASE sd WHEN 1 THEN 'first' ELSE 'second' END AS side,
         o_orderpriority || '/' || CASE sd WHEN 1 THEN 'first' ELSE 'second' END AS instruction,
         l_returnflag AS framing, l_linestatus AS channel, p_brand AS author, l_discount >= 0.05 AS completed
  FROM obs_s JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
obs AS (
  SELECT *, substr(sha256('{"assistant":"' || assistant || '","input":{"author":"' || author || '","channel":"' || channel
         || '","framing":"' || framing || '","instruction":"' || instruction || '"}}'), 1, 16) AS cell_id,
         CASE WHEN pair_id < '3' THEN 'urgent' ELSE 'routine' END AS skill,
         'conflict ' || substr(pair_id, 1, 1) AS conflict
  FROM obs_raw)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial and position."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount", *LINE_ORDER)
    by_order = Window.partitionBy("l_orderkey")
    lines = lines.withColumn("rn", F.row_number().over(by_order.orderBy(*LINE_ORDER))).where("rn <= 2")
    lines = lines.withColumn("k", F.count(F.lit(1)).over(by_order)).where("k = 2")
    lines = lines.withColumn("sd", F.row_number().over(by_order.orderBy("l_partkey", "l_suppkey", "rn")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    side = F.when(F.col("sd") == 1, "first").otherwise("second")
    rows = rows.select(
        F.col("l_orderkey").alias("trial_id"),
        F.col("rn").alias("position"),
        F.col("o_orderstatus").alias("assistant"),
        F.col("o_orderpriority").alias("pair_id"),
        side.alias("side"),
        F.concat("o_orderpriority", F.lit("/"), side).alias("instruction"),
        F.col("l_returnflag").alias("framing"),
        F.col("l_linestatus").alias("channel"),
        F.col("p_brand").alias("author"),
        (F.col("l_discount") >= 0.05).alias("completed"),
    )
    rows = rows.withColumn("cell_id", cell_id(*(F.col(c) for c in ("instruction", "framing", "channel", "author", "assistant"))))
    return rows.withColumn("skill", F.when(F.col("pair_id") < "3", "urgent").otherwise("routine")).withColumn("conflict", F.concat(F.lit("conflict "), F.substring("pair_id", 1, 1)))


def pair_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the fixture as a bank of instructions."""
    pair = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pair_id")).distinct()
    return pair.select(
        "pair_id",
        F.when(F.col("pair_id") < "3", "urgent").otherwise("routine").alias("skill"),
        F.concat(F.lit("conflict "), F.substring("pair_id", 1, 1)).alias("conflict"),
        F.concat("pair_id", F.lit("/first")).alias("first"),
        F.concat("pair_id", F.lit("/second")).alias("second"),
        F.lit("").alias("rationale"),
    )
