"""An analysis reads its trials from one table and everything else from counts."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairforge.operators import lasso, ranking, reports, trials
from pairforge.operators.validate import InvalidData
from pairforge.plans import bundle
from pairforge.plans.fixture import observations, pair_bank
from pairforge.shared import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names)) for r in df.collect())


@pytest.fixture(scope="module")
def obs(spark):
    return materialize(spark, observations(spark, SF), "test-observations")[0]


def mixed(obs):
    """Some trials whose sides differ in pair, skill or assistant, or lack one or the outcome."""
    to = lambda c, k, value: F.when((F.col("trial_id") % 7 == k) & (F.col("position") == 2), value).otherwise(F.col(c))
    both = lambda c, k: F.when(F.col("trial_id") % 7 == k, None).otherwise(F.col(c))
    new = {"pair_id": to("pair_id", 0, F.lit("other")), "skill": to("skill", 1, F.lit(None)), "assistant": to("assistant", 2, F.lit("other"))}
    return obs.withColumns(new).withColumns({"conflict": both("conflict", 3), "completed": to("completed", 4, F.lit(None).cast("boolean"))}).withColumn("pair_id", both("pair_id", 5))


@pytest.mark.parametrize("change", [lambda obs: obs, mixed, lambda obs: obs.where("false")])
def test_trials_and_counts_give_what_observations_give(obs, change):
    obs = change(obs)
    stored = trials.checked_trials(obs)
    cells = trials.cell_counts(stored)
    assert rows(trials.comparisons(stored)) == rows(ranking.comparisons(obs))
    assert rows(trials.pair_exclusivity(stored)) == rows(reports.pair_exclusivity(obs))
    assert rows(lasso.counted_rows(trials.within(stored, "assistant", "pair_id"))) == rows(lasso.comparison_rows(obs))
    for report in (reports.axis_summary, reports.stratum_summary, reports.position_summary, reports.cell_position_effects, reports.axis_position_effects, reports.order_sensitivity, reports.position_balance):
        assert rows(report(cells)) == rows(report(obs))


def test_a_trial_of_three_rows_is_an_error(obs):
    with pytest.raises(InvalidData, match="not two rows"):
        trials.checked_trials(obs.unionByName(obs.where("position = 1").limit(1)))


def read(spark, out):
    """Rows of all folders that the tables read, other than the driver's tables."""
    folders = {os.path.dirname(f) for df in out.tables.values() for f in df.inputFiles() if "pairforge-" in f}
    return sum(spark.read.parquet(f).count() for f in folders)


def test_tables_read_no_more_rows_of_more_trials(spark, obs):
    """Three times the trials: the same rows are read for the tables, and three times as many counted."""
    obs = obs.where("pair_id < '3'")
    cfg = bundle.AnalysisConfig(ranking.FitConfig(bootstrap=2), True, lasso.LassoConfig(path=3, folds=2))
    more = obs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("trial_id", F.col("trial_id") * 3 + F.col("copy")).drop("copy")
    one, three = (bundle.analyse(x, pair_bank(spark, SF), cfg) for x in (obs, more))
    assert read(spark, one) == read(spark, three)
    total = defaultdict(int)
    for name, out in (("one", one), ("three", three)):
        for r in out.tables["cell_ranking"].collect():
            total[name] += r["observations"]
        assert out.diagnostics.first()["trials"] * 2 == out.diagnostics.first()["observations"] == total[name]
    assert total["three"] == 3 * total["one"] == 3 * obs.count()
