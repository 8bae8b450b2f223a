"""Grouped reports over observations: rates, contrasts, order effects, balance, attrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.stats import guarded_corr, smoothed_odds, wilson
from pairforge.schema import AXES, STRATA

OUTCOMES = ("exactly_one", "both_completed", "neither_completed")
CELL = ("instruction", "framing", "channel", "author", "assistant")


def measured(obs: DataFrame) -> list[str]:
    """What is counted: completed of each observation, or n and k where rows are counts of observations already."""
    return ["completed"] if "completed" in obs.columns else ["n", "k"]


def tally(obs: DataFrame, n: str = "n", k: str = "k") -> list[Column]:
    """Observations and completions of a group, from either kind of rows."""
    if measured(obs) == ["completed"]:
        return [F.count(F.lit(1)).alias(n), F.count_if("completed").alias(k)]
    return [F.sum("n").alias(n), F.sum("k").alias(k)]


def with_rates(counts: DataFrame) -> DataFrame:
    n, k = F.col("observations"), F.col("completions")
    low, high = wilson(k, n)
    return counts.withColumn("completion_rate", k / n).withColumn("wilson_low", low).withColumn("wilson_high", high)


def unpivot(obs: DataFrame, columns: tuple[str, ...], name: str, keep: list[str]) -> DataFrame:
    """One row per observation and column, so several groupings share one scan and one shuffle."""
    return obs.unpivot(keep, list(columns), name, "value")


def axis_summary(obs: DataFrame, scores: DataFrame | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Rates by axis and value; with scores (cell_id, score) also their mean over distinct cells.

    Counts are taken by (axis, value, cell) first, which serves both the rates and the cells.
    """
    cells = unpivot(obs, axes, "axis", ["cell_id", *measured(obs)]).groupBy("axis", "value", "cell_id").agg(*tally(obs))
    out = [F.sum("n").alias("observations"), F.sum("k").alias("completions"), F.count(F.lit(1)).alias("cells")]
    if scores is not None:
        cells = cells.join(scores.select("cell_id", "score"), "cell_id", "left")
        out.append(F.avg("score").alias("mean_bt_score"))
    return with_rates(cells.groupBy("axis", "value").agg(*out))


def axis_comparisons(summary: DataFrame) -> DataFrame:
    """Differences of every two values of an axis."""
    fields = [c for c in ("observations", "completions", "completion_rate", "mean_bt_score") if c in summary.columns]
    a = summary.select("axis", F.col("value").alias("first"), *(F.col(c).alias(f"a_{c}") for c in fields))
    b = summary.select("axis", F.col("value").alias("second"), *(F.col(c).alias(f"b_{c}") for c in fields))
    both = a.join(b, "axis").where("first < second")
    odds = lambda s: smoothed_odds(F.col(f"{s}_completions"), F.col(f"{s}_observations"))
    out = ["axis", "first", "second", (F.col("a_completion_rate") - F.col("b_completion_rate")).alias("completion_rate_difference"), (odds("a") / odds("b")).alias("odds_ratio")]
    if "mean_bt_score" in fields:
        out.append((F.col("a_mean_bt_score") - F.col("b_mean_bt_score")).alias("mean_bt_score_difference"))
    return both.select(*out)


def stratum_summary(obs: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Rates by what is constant within a trial: assistant, skill, conflict, pair."""
    rows = obs.withColumnRenamed("pair_id", "pair")
    cells = unpivot(rows, strata, "stratum", ["cell_id", *measured(obs)]).groupBy("stratum", "value", "cell_id").agg(*tally(obs))
    return with_rates(cells.groupBy("stratum", "value").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("observations"), F.sum("k").alias("completions")))


def outcome() -> Column:
    """Of a trial with sides a and b: 1 or 0, or a half for a tie."""
    return F.when(F.col("a.completed") == F.col("b.completed"), 0.5).when(F.col("a.completed"), 1.0).otherwise(0.0)


def trial_outcomes(obs: DataFrame) -> DataFrame:
    """(trial_id, pair, skill, conflict, exactly_one, both_completed, neither_completed): 1 or 0 each."""
    return outcomes(obs.groupBy("pair_id", "skill", "conflict", "trial_id").agg(F.count_if("completed").alias("k"), F.count(F.lit(1)).alias("n")))


def outcomes(trials: DataFrame) -> DataFrame:
    """trial_outcomes, of rows with pair_id, skill, conflict, trial_id, and how many k of its n instructions were completed."""
    k, n = F.col("k"), F.col("n")
    one, both = k == 1, (k != 1) & (k == n)
    return trials.select("trial_id", F.col("pair_id").alias("pair"), "skill", "conflict", *(c.cast("long").alias(name) for c, name in zip((one, both, ~one & ~both), OUTCOMES, strict=True)))


def outcome_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"{c}_rate": F.col(c) / F.col("trials") for c in OUTCOMES})


def pair_exclusivity(obs: DataFrame) -> DataFrame:
    """How many trials of a pair completed exactly one, both, or neither instruction."""
    return exclusivity(trial_outcomes(obs))


def exclusivity(trials: DataFrame) -> DataFrame:
    """pair_exclusivity, of trial_outcomes."""
    return outcome_rates(trials.groupBy("pair", "skill", "conflict").agg(F.count(F.lit(1)).alias("trials"), *(F.sum(c).alias(c) for c in OUTCOMES)))


def position_summary(obs: DataFrame) -> DataFrame:
    return with_rates(obs.groupBy("position").agg(*tally(obs, "observations", "completions")))


def _moments(n: str = "n") -> list[Column]:
    """Sums that give rates and the position correlation of a coarser group."""
    p = F.col("position").cast("double")
    return [F.sum(n).alias("observations"), F.sum("k").alias("completions"), F.sum(p * F.col(n)).alias("sp"), F.sum(p * p * F.col(n)).alias("spp"), F.sum(p * F.col("k")).alias("spk")]


def _correlation() -> Column:
    """Pearson correlation of position and outcome from the sums; null if either does not vary."""
    n, k, sp = F.col("observations").cast("double"), F.col("completions").cast("double"), F.col("sp")
    return F.try_divide(n * F.col("spk") - sp * k, F.sqrt((n * F.col("spp") - sp * sp) * (n * k - k * k)))


def _by_position(obs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by keys and position, and by keys alone: one aggregate over the rows, one over its result."""
    fine = obs.groupBy(*keys, "position").agg(*tally(obs))
    rate = F.col("k") / F.col("n")
    whole = fine.groupBy(*keys).agg(*_moments(), F.min(rate).alias("min_position_rate"), F.max(rate).alias("max_position_rate"))
    whole = whole.select(*keys, "observations", "completions", _correlation().alias("position_correlation"), "min_position_rate", "max_position_rate")
    return fine.select(*keys, "position", F.col("n").alias("observations"), F.col("k").alias("completions")), whole


def cell_position_effects(obs: DataFrame) -> DataFrame:
    keys = ["cell_id", *CELL]
    fine, whole = _by_position(obs, keys)
    whole = whole.select("cell_id", (F.col("completions") / F.col("observations")).alias("overall"))
    out = with_rates(fine).join(whole, "cell_id")
    return out.withColumn("delta_from_cell_rate", F.col("completion_rate") - F.col("overall")).drop("overall")


def axis_position_effects(obs: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    fine, whole = _by_position(unpivot(obs, axes, "axis", ["position", *measured(obs)]), ["axis", "value"])
    whole = whole.select("axis", "value", (F.col("completions") / F.col("observations")).alias("overall"), "position_correlation")
    out = with_rates(fine).join(whole, ["axis", "value"])
    return out.withColumn("delta_from_axis_value_rate", F.col("completion_rate") - F.col("overall")).drop("overall")


def order_sensitivity(obs: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Range of position rates of every cell and axis value, widest first."""
    _, cells = _by_position(obs, ["cell_id", *CELL])
    _, values = _by_position(unpivot(obs, axes, "axis", ["position", *measured(obs)]), ["axis", "value"])
    cells = cells.withColumn("kind", F.lit("cell")).withColumn("value", F.col("cell_id"))
    both = cells.unionByName(values.withColumn("kind", F.lit("axis")), allowMissingColumns=True)
    both = both.withColumn("position_rate_range", F.col("max_position_rate") - F.col("min_position_rate"))
    columns = ["kind", "axis", "cell_id", *CELL, "value", "observations", "position_correlation", "min_position_rate", "max_position_rate", "position_rate_range"]
    return both.select(*columns).orderBy(F.desc("position_rate_range"), "kind", "value")


def position_balance(obs: DataFrame) -> DataFrame:
    """Whether a cell has every position from 1 up equally often."""
    fine = obs.groupBy("cell_id", "position").agg(*tally(obs))
    out = fine.groupBy("cell_id").agg(F.min("n").alias("count_min"), F.max("n").alias("count_max"), F.count(F.lit(1)).alias("positions"), F.max("position").alias("last_position"), F.min("position").alias("first_position"))
    balanced = (F.col("count_min") == F.col("count_max")) & (F.col("first_position") == 1) & (F.col("positions") == F.col("last_position"))
    return out.select("cell_id", "count_min", "count_max", "positions", balanced.alias("balanced"))


def bank_coverage(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("skill", "conflict").agg(F.count(F.lit(1)).alias("pairs"))


def correlation_by(obs: DataFrame, *keys: str) -> DataFrame:
    """Correlation of position and outcome of each group, straight from the rows."""
    return obs.groupBy(*keys).agg(guarded_corr(F.col("position").cast("double"), F.col("completed").cast("double")).alias("position_correlation"))


def attrition_by_axis(studies: DataFrame, rejected: DataFrame, axes: tuple[str, ...] = ("instruction", *AXES)) -> DataFrame:
    """Planned and excluded comparisons and trials by axis value.

    studies: study_id, assistant, rollouts, input1, input2; rejected: the four spec columns. A study is
    excluded if either input is rejected, and counts once for each distinct value of its two inputs.
    """
    sides = studies.select("study_id", "assistant", "rollouts", F.explode(F.array("input1", "input2")).alias("spec")).select("study_id", "assistant", "rollouts", *(F.col(f"spec.{a}").alias(a) for a in axes))
    bad = rejected.select(*axes).distinct().withColumn("bad", F.lit(1))
    judged = sides.join(bad, list(axes), "left").groupBy("study_id", "assistant", "rollouts").agg(F.max(F.coalesce("bad", F.lit(0))).alias("excluded"), *(F.collect_set(a).alias(a) for a in axes))
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("values")) for a in axes), F.struct(F.lit("assistant").alias("axis"), F.array("assistant").alias("values")))
    rows = judged.select("excluded", (F.col("rollouts") * 2).alias("trials"), F.explode(pairs).alias("p")).select("excluded", "trials", "p.axis", F.explode("p.values").alias("value"))
    return rows.groupBy("axis", "value").agg(
        F.count(F.lit(1)).alias("planned_comparisons"), F.sum("excluded").cast("long").alias("excluded_comparisons"), F.sum("trials").cast("long").alias("planned_trials"), F.sum(F.col("trials") * F.col("excluded")).cast("long").alias("excluded_trials")
    )
