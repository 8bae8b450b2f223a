"""Reports that follow their observations: counts at the finest grain are stored, and a batch adds to and takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import reports
from pairforge.operators.reports import OUTCOMES
from pairforge.shared import literal, materialize
from pairforge.sources.buckets import KeyedTable

#: What observations are told apart by, and counted within.
GRAIN = {"cell_id": "string", "instruction": "string", "framing": "string", "channel": "string", "author": "string", "assistant": "string", "pair_id": "string", "side": "string", "skill": "string", "conflict": "string", "position": "int"}
PAIR = {"pair": "string", "skill": "string", "conflict": "string"}


def _compact(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + ">"


OBSERVED = _compact(GRAIN | {"completed": "boolean"})
STORED = f"kind string, key string, rows array<{OBSERVED}>, cell {_compact(GRAIN)}, pair {_compact(PAIR)}, counts array<bigint>"


class IncrementalReports:
    """Observations by trial, and the counts that reports are read from, in one keyed table.

    add() takes a batch of observations, whole trials: a trial that is there already is replaced, so what it counted is taken away.
    Trials and counts change in one commit, so a lost batch leaves nothing, and a batch that comes twice changes nothing. Its cost is
    that of the buckets it touches. A trial's rows are an array, two in this design.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.table = KeyedTable(spark, path, STORED, ["kind", "key"], buckets)

    def add(self, batch: DataFrame) -> None:
        row = F.struct(*(F.col(c).cast(k).alias(c) for c, k in GRAIN.items()), F.col("completed").alias("completed"))
        trials = batch.groupBy(F.col("trial_id").cast("string").alias("key")).agg(F.sort_array(F.collect_set(row)).alias("rows"))
        new, _ = materialize(self.spark, trials.withColumn("kind", F.lit("trial")), "batch")
        old, _ = materialize(self.spark, self.table.matching(new).select("key", "rows"), "replaced")
        both = new.select("key", "rows", F.lit(1).cast("long").alias("sign")).unionByName(old.withColumn("sign", F.lit(-1).cast("long")))
        seen = both.select(F.col("key").alias("trial_id"), "sign", F.explode("rows").alias("r")).select("trial_id", "sign", "r.*")
        cell, pair = F.struct(*GRAIN), F.struct(*PAIR)
        of_cells = seen.groupBy(cell.alias("cell")).agg(F.array(F.sum("sign"), F.sum(F.col("sign") * F.col("completed").cast("long"))).alias("counts"))
        outcomes = reports.trial_outcomes(seen.withColumn("trial_id", F.struct("trial_id", "sign"))).withColumn("sign", F.col("trial_id.sign"))
        of_pairs = outcomes.groupBy(pair.alias("pair")).agg(F.array(F.sum("sign"), *(F.sum(F.col("sign") * F.col(c)) for c in OUTCOMES)).alias("counts"))
        changed = self._changed(of_cells, "cell").unionByName(self._changed(of_pairs, "pair"), allowMissingColumns=True)
        self.table.put(changed.unionByName(new, allowMissingColumns=True).select(*self.table.columns))

    def _changed(self, delta: DataFrame, kind: str) -> DataFrame:
        """The new counts of every cell or pair that a batch changes."""
        key: Column = F.sha2(F.to_json(kind, {"ignoreNullFields": "false"}), 256)
        delta = delta.where(F.exists("counts", lambda c: c != 0)).select(F.lit(kind).alias("kind"), key.alias("key"), kind, "counts")
        delta, _ = materialize(self.spark, delta, f"delta-{kind}")
        old = self.table.matching(delta).select("key", F.col("counts").alias("before"))
        total = F.when(F.col("before").isNull(), F.col("counts")).otherwise(F.zip_with("before", "counts", lambda a, b: a + b))
        empty = literal(self.spark, [], STORED).drop(*({"cell", "pair"} - {kind}), "rows")
        return empty.unionByName(delta.join(old, "key", "left").select("kind", "key", kind, total.alias("counts")))

    def cells(self) -> DataFrame:
        """Counts n and k of observations and completions by cell, position and stratum: what reports take instead of observations."""
        states = self.table.read().where("kind = 'cell' AND counts[0] > 0")
        return states.select("cell.*", F.col("counts")[0].alias("n"), F.col("counts")[1].alias("k"))

    def exclusivity(self) -> DataFrame:
        states = self.table.read().where("kind = 'pair' AND counts[0] > 0")
        return reports.outcome_rates(states.select("pair.*", *(F.col("counts")[i].alias(c) for i, c in enumerate(("trials", *OUTCOMES)))))

    def reports(self) -> dict[str, DataFrame]:
        """Every report on rates, positions, orders and balance, from the counts alone."""
        cells, _ = materialize(self.spark, self.cells(), "cells")
        axis = reports.axis_summary(cells)
        return {
            "axis_summary": axis,
            "axis_comparisons": reports.axis_comparisons(axis),
            "stratum_summary": reports.stratum_summary(cells),
            "pair_exclusivity": self.exclusivity(),
            "position_summary": reports.position_summary(cells),
            "cell_position_effects": reports.cell_position_effects(cells),
            "axis_position_effects": reports.axis_position_effects(cells),
            "order_sensitivity": reports.order_sensitivity(cells),
            "position_balance": reports.position_balance(cells),
        }
