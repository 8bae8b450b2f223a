"""Trials as rows, both sides beside each other: what looks at trials shares one shuffle of the observations, and what looks at cells
shares one count, whose rows the design bounds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import reports
from pairforge.operators.checks import checked, trial_rules

#: What a side of a trial keeps. Sides are put in this order, so by cell id.
SIDE = ("cell_id", "framing", "channel", "author", "position", "completed", "side", "instruction", "assistant", "pair_id", "skill", "conflict")


def checked_trials(obs: DataFrame) -> DataFrame:
    """(trial_id, a, b), stored; a trial that is not two cells at positions 1 and 2 is an error, found in the same pass."""
    side = F.struct(*SIDE)
    rows = obs.groupBy("trial_id").agg(F.min(side).alias("a"), F.max(side).alias("b"), F.count(F.lit(1)).alias("rows"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    rows = rows.withColumns({"first": F.col("a.cell_id"), "second": F.col("b.cell_id")})
    return checked(rows, trial_rules(), "trials", ("trial_id",), ["trial_id", "a", "b"])


def comparisons(trials: DataFrame) -> DataFrame:
    """(trial_id, first, second, outcome), as of observations."""
    return trials.select("trial_id", F.col("a.cell_id").alias("first"), F.col("b.cell_id").alias("second"), reports.outcome().alias("outcome"))


def cell_counts(trials: DataFrame) -> DataFrame:
    """Counts n and k of observations and completions by cell, position and stratum: what reports take instead of observations."""
    sides = trials.select(F.explode(F.array("a", "b")).alias("s")).select("s.*")
    return sides.groupBy(*(c for c in SIDE if c != "completed")).agg(*reports.tally(sides))


def within(trials: DataFrame, *keys: str) -> DataFrame:
    """(trial_id, keys, a, b, n): trials grouped by keys too, as observations would be. Sides that differ in a key are groups of one row."""
    same = reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys))
    group = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(n).alias("n"))
    groups = F.when(same, F.array(group("a", "b", 2))).otherwise(F.array(group("a", "a", 1), group("b", "b", 1)))
    return trials.select("trial_id", F.explode(groups).alias("g")).select("trial_id", *(F.col(f"g.a.{c}").alias(c) for c in keys), "g.a", "g.b", "g.n")


def pair_exclusivity(trials: DataFrame) -> DataFrame:
    """reports.pair_exclusivity, of trials."""
    done = lambda side: F.coalesce(F.col(f"{side}.completed").cast("int"), F.lit(0))
    rows = within(trials, "pair_id", "skill", "conflict")
    return reports.exclusivity(reports.outcomes(rows.withColumn("k", done("a") + F.when(F.col("n") == 2, done("b")).otherwise(0))))
