"""Completeness of probe measurements: what became of every request that the studies plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.checks import Rule, violations
from pairforge.shared import dealt

COORDINATE = ("study_id", "permutation", "position")


def _outcomes(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """(coordinate, kind, complies, masked, fingerprint, reason): scores and issues as rows of one kind."""
    empty = lambda kind: F.lit(None).cast(kind)
    scored = scores.select(*COORDINATE, F.lit("score").alias("kind"), "complies", "masked", F.col("context_fingerprint").alias("fingerprint"), empty("string").alias("reason"))
    return scored.unionByName(issues.select(*COORDINATE, "kind", empty("boolean").alias("complies"), empty("long").alias("masked"), empty("string").alias("fingerprint"), "reason"))


def request_outcomes(requests: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Every planned request with what became of it: score, missing or error with its reason, or unclassified.

    requests: the coordinate, assistant and spec; scores: the coordinate, context_fingerprint, complies (null: nothing is expected)
    and masked; issues: the coordinate, kind (missing or error) and reason. A coordinate that is classified twice has a row each.
    Requests are counted first and dealt by their coordinates, so a task's memory does not grow with them.
    """
    n = requests.count()
    return dealt(requests, n, *COORDINATE).join(dealt(_outcomes(scores, issues), n, *COORDINATE), list(COORDINATE), "left").select("assistant", *COORDINATE, "spec", F.coalesce("kind", F.lit("unclassified")).alias("outcome"), "complies", "masked", "fingerprint", "reason")


def request_violations(requests: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """(rule, study_id, permutation, position): coordinates that no study plans, or that are not classified exactly once, and those
    whose scored context is also that of another coordinate of the study (both, by the study alone: permutation and position null).

    Requests are counted first and dealt by their coordinates, so a task's memory does not grow with them."""
    n = requests.count()
    planned = dealt(requests.select(*COORDINATE), n, *COORDINATE).groupBy(*COORDINATE).agg(F.count(F.lit(1)).alias("planned"))
    found = dealt(_outcomes(scores, issues).select(*COORDINATE), n, *COORDINATE).groupBy(*COORDINATE).agg(F.count(F.lit(1)).alias("classified"))
    both = planned.join(found, list(COORDINATE), "full")
    p, m = (F.coalesce(c, F.lit(0)) for c in ("planned", "classified"))
    rules = [Rule("not planned", p == 0), Rule("planned twice", p > 1), Rule("not classified", (p > 0) & (m == 0)), Rule("classified twice", m > 1)]
    marks = dealt(scores.select("study_id", "context_fingerprint"), n, "study_id").groupBy("study_id", "context_fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("study_id").distinct()
    shared = marks.select(F.lit("contexts alike").alias("rule"), "study_id", F.lit(None).cast("int").alias("permutation"), F.lit(None).cast("int").alias("position"))
    return violations(both, rules, *COORDINATE).unionByName(shared)


def request_counts(outcomes: DataFrame) -> DataFrame:
    """One row: planned requests, scores (directional, descriptive, against the expectation), missing, errors and the coverage."""
    of = lambda kind: F.col("outcome") == kind
    return outcomes.agg(
        F.countDistinct(*COORDINATE).alias("planned_requests"),
        F.count_if(of("score")).alias("scores"),
        F.count_if(of("score") & F.col("complies").isNotNull()).alias("directional_scores"),
        F.count_if(of("score") & F.col("complies").isNull()).alias("descriptive_scores"),
        F.count_if(of("score") & ~F.col("complies")).alias("reference_mismatches"),
        F.count_if(of("missing")).alias("missing_requests"),
        F.count_if(of("error")).alias("error_requests"),
        F.coalesce(F.try_divide(F.count_if(of("score")), F.countDistinct(*COORDINATE)), F.lit(1.0)).alias("coverage"),
        F.coalesce(F.sum(F.when(of("score"), F.col("masked"))), F.lit(0)).cast("long").alias("masked_boundary_tokens"),
    )
