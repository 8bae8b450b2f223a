"""Connected components by label propagation, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.shared import materialize, ship, unused


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of a few edges."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.record_batch([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "label"])


def components(nodes: DataFrame, edges: DataFrame, in_one_task: int = 500_000) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without an edge keep their own.

    nodes: (node); edges: (a, b). Each round takes the smallest label around a node, then the label's
    own label, and writes the table, so the lineage stays short and lost executors cost one round. A graph of
    at most `in_one_task` edges, which are counted first, is labelled by union-find in one task instead.
    """
    spark = nodes.sparkSession
    single, _ = materialize(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    if single.count() <= in_one_task:
        ship(spark)
        kind = dict(nodes.dtypes)["node"]
        found = single.coalesce(1).mapInArrow(_union_find, f"node {kind}, label {kind}")
        return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    both = single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(around, "node", "left").select("node", F.col("label").alias("old"), F.coalesce(F.least("label", "m"), "label").alias("label"))
        lower, _ = materialize(spark, lower, "labels")
        jump = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        done, _ = materialize(spark, jump.select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = done.select("node", "label")
        if done.where("old <> label").isEmpty():
            return labels


def cumulative(rows: DataFrame, order: str, sums: list[str], part: int = 1_000_000) -> DataFrame:
    """Adds before_<c>, the sum of c over rows of smaller order (which must be distinct), and `following`, the next order.

    Rows are counted and dealt into ranges of about `part` rows, each summed in a window of its own; the ranges' totals, one row for
    each, are summed in a window in turn. So no task holds more than a range or the totals, and nothing goes to the driver.
    """
    spark, parts = rows.sparkSession, max(1, -(-rows.count() // part))
    at, lo, later = (unused(rows, n) for n in ("part", "lo", "later"))
    so_far = {c: unused(rows, f"so_far_{c}") for c in sums}
    dealt = rows.withColumn(at, F.lit(0))
    if parts > 1:
        dealt, _ = materialize(spark, rows.repartitionByRange(parts, order).withColumn(at, F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(at).agg(F.min(order).alias(lo), *(F.sum(c).alias(so_far[c]) for c in sums))
    by_part = Window.orderBy(at)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(at, F.lead(lo).over(by_part).alias(later), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in so_far.values()))
    mine = Window.partitionBy(at).orderBy(order)
    earlier = mine.rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), at)  # one row a range: a millionth of the rows
    here = [(F.col(so_far[c]) + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"before_{c}") for c in sums]
    return joined.select(*rows.columns, F.coalesce(F.lead(order).over(mine), F.col(later)).alias("following"), *here)


def component_index(labels: DataFrame) -> DataFrame:
    """Adds component: 0, 1, ... in the order of the smallest members, numbered within ranges of them."""
    roots, _ = materialize(labels.sparkSession, labels.where("node = label").select("label"), "roots")
    numbered = cumulative(roots.withColumn("one", F.lit(1).cast("long")), "label", ["one"])
    return labels.join(numbered.select("label", F.col("before_one").cast("int").alias("component")), "label").select("node", "label", "component")
