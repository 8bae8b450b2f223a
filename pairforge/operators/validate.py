"""Checks that return the rows that break a rule; no rows means the table is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import is_slug, is_trimmed
from pairforge.schema import USER_CHANNEL, AxisOrder


class InvalidData(ValueError):
    """Raised by require_empty."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed with a few examples."""
    found = violations.limit(5).collect()
    if found:
        raise InvalidData(f"{what}: {[r.asDict() for r in found]}")


def trial_violations(obs: DataFrame) -> DataFrame:
    """(trial_id, problem): trials that are not two rows at positions 1 and 2 with constant metadata."""
    constant = [c for c in ("permutation", "rollout", "assistant", "trace_fingerprint") if c in obs.columns]
    aggregates = [F.count(F.lit(1)).alias("rows"), F.countDistinct("cell_id").alias("cells"), F.min("position").alias("lo"), F.max("position").alias("hi")]
    aggregates += [F.min(c).alias(f"min_{c}") for c in constant] + [F.max(c).alias(f"max_{c}") for c in constant]
    trials = obs.groupBy("trial_id").agg(*aggregates)
    tests: list[tuple[Column, str]] = [(F.col("cells") < F.col("rows"), "repeated cell"), (F.col("rows") != 2, "not two rows"), ((F.col("lo") != 1) | (F.col("hi") != 2), "positions")]
    tests += [(~F.col(f"min_{c}").eqNullSafe(F.col(f"max_{c}")), c) for c in constant]
    problems = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in tests)))
    return trials.select("trial_id", F.explode(problems).alias("problem"))


def cell_violations(obs: DataFrame) -> DataFrame:
    """Cell ids that stand for more than one coordinate."""
    coordinate = F.struct("instruction", "framing", "channel", "author", "assistant")
    return obs.groupBy("cell_id").agg(F.min(coordinate).alias("lo"), F.max(coordinate).alias("hi")).where("lo <> hi").select("cell_id")


def membership_violations(obs: DataFrame, bank: DataFrame) -> DataFrame:
    """(trial_id, problem): unknown instruction, two pairs in a trial, or one side twice."""
    sides = bank.select("pair_id", F.expr("stack(2, 'first', first, 'second', second) as (side, instruction)"))
    rows = obs.select("trial_id", "instruction").join(sides, "instruction", "left")
    trials = rows.groupBy("trial_id").agg(F.count_if(F.col("pair_id").isNull()).alias("unknown"), F.countDistinct("pair_id").alias("pairs"), F.countDistinct("side").alias("sides"), F.count(F.lit(1)).alias("rows"))
    problem = F.when(F.col("unknown") > 0, "unknown instruction").when(F.col("pairs") != 1, "several pairs").when(F.col("sides") != F.col("rows"), "repeated side")
    return trials.select("trial_id", problem.alias("problem")).where("problem IS NOT NULL")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def repeated_instructions(bank: DataFrame) -> DataFrame:
    return repeated(bank.select(F.explode(F.array("first", "second")).alias("instruction")), "instruction")


def pair_violations(bank: DataFrame) -> DataFrame:
    return bank.where(~is_slug(F.col("pair_id")) | (F.col("first") == F.col("second")) | ~is_trimmed(F.col("first")) | ~is_trimmed(F.col("second")))


def writable(author: Column, framing: Column, order: AxisOrder | None = None) -> Column:
    """The user writes only the manual framings."""
    return (author != "user") | framing.isin(*(order or AxisOrder()).manual)


def spec_violations(specs: DataFrame, order: AxisOrder | None = None) -> DataFrame:
    order = order or AxisOrder()
    known = F.col("framing").isin(*order.framing) & F.col("channel").isin(*order.channel) & F.col("author").isin(*order.author)
    return specs.where(~known | ~writable(F.col("author"), F.col("framing"), order) | ~is_trimmed(F.col("instruction")))


def side_violations(specs: DataFrame) -> DataFrame:
    """(pair_id, problem): sides that are missing, hold a specification twice, share one with the other side, or
    cannot reach the other because neither has a specification in the user's channel."""
    key = ("pair_id", "framing", "channel", "author", "instruction")
    user = F.count_if(F.col("channel") == USER_CHANNEL)
    count = specs.groupBy("pair_id").agg(F.countDistinct("side").alias("sides"), user.alias("users"))
    twice = specs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("sides")).where("n > 1")
    empty = count.where("sides < 2").select("pair_id", F.lit("missing side").alias("problem"))
    lonely = count.where("users = 0").select("pair_id", F.lit("no user channel").alias("problem"))
    same = twice.select("pair_id", F.when(F.col("sides") > 1, "shared by both sides").otherwise("repeated").alias("problem")).distinct()
    return empty.unionByName(lonely).unionByName(same)


def require_compliant(audit: DataFrame) -> None:
    """Fail closed if any message of an audit does not comply or was not decided."""
    require_empty(audit.where(~F.coalesce(F.col("complies"), F.lit(False))), "messages that do not comply")


def study_violations(studies: DataFrame) -> DataFrame:
    """Studies with equal inputs, no user channel, or no rollout."""
    no_user = (F.col("input1.channel") != USER_CHANNEL) & (F.col("input2.channel") != USER_CHANNEL)
    return studies.where((F.col("input1") == F.col("input2")) | no_user | (F.col("rollouts") < 1))


def side_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.intersect(second)


def coordinate_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side only, with their side."""
    return actual.exceptAll(expected).withColumn("side", F.lit("unexpected")).unionByName(expected.exceptAll(actual).withColumn("side", F.lit("missing")))


def unsafe_messages(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("complies"))


def status_mismatches(judgments: DataFrame) -> DataFrame:
    """Judged traces that did not complete, or completed ones judged without a judge's response."""
    done = F.col("terminal_status") == "completed"
    return judgments.where(done != F.col("judge_response_id").isNotNull())


def score_xor_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates that are not exactly one of scored or in error."""
    return rows.groupBy(*keys).agg(F.count_if(F.col("score").isNotNull()).alias("scores"), F.count_if(F.col("error").isNotNull()).alias("errors")).where("scores + errors <> 1")


def role_probability_violations(rows: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("role_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.abs(total - 1) > 1e-6)
