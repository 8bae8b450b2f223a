"""Suites of studies: summaries, work counts, binding to pairs, comparison of two runs, contexts to score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.observe import SPEC
from pairforge.operators.validate import require_empty
from pairforge.schema import FRAMINGS


def _specs(studies: DataFrame) -> DataFrame:
    return studies.select("study_id", "assistant", F.explode(F.array("input1", "input2")).alias("s")).select("study_id", "assistant", "s.*")


def study_summaries(studies: DataFrame, rejected: DataFrame, traces: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row for each study: its trials, those excluded with a rejected input, and what is saved of the rest.

    traces: study_id, trial_id, terminal_status; judgments: study_id, trial_id. A saved judgment gives two observations.
    """
    bad = _specs(studies).join(rejected.select(*SPEC).distinct(), list(SPEC), "left_semi").select("study_id").distinct().withColumn("bad", F.lit(1))
    saved = traces.groupBy("study_id").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("terminal_status") != "completed").alias("f"))
    judged = judgments.groupBy("study_id").agg(F.count(F.lit(1)).alias("j"))
    rows = studies.select("study_id", "assistant", (F.col("rollouts") * 2).cast("long").alias("trials")).join(bad, "study_id", "left").join(saved, "study_id", "left").join(judged, "study_id", "left")
    out = F.coalesce("bad", F.lit(0)).cast("long")
    kept = lambda c: F.when(out == 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select("study_id", "assistant", F.lit(2).alias("cells"), "trials", out.alias("excluded_comparisons"), (out * F.col("trials")).alias("excluded_trials"), kept("t").alias("trace_cache_hits"), kept("f").alias("failed_trials"), kept("j").alias("judgment_cache_hits"), (2 * kept("j")).alias("observations"))


def collection_summary(summaries: DataFrame) -> DataFrame:
    """Totals of study_summaries, one row for each assistant."""
    names = ("trials", "excluded_comparisons", "excluded_trials", "observations", "failed_trials")
    return summaries.groupBy("assistant").agg(F.count(F.lit(1)).alias("studies"), *(F.sum(c).cast("long").alias(c) for c in names))


@dataclass(frozen=True)
class SuiteRules:
    """What a suite of one assistant may be."""

    studies: int = 32
    framings: tuple[str, ...] = FRAMINGS
    author_of_user: str = "user"


def work_counts(studies: DataFrame) -> DataFrame:
    """Studies, distinct inputs and the requests they ask for, of each assistant."""
    specs = _specs(studies).select("assistant", *SPEC).distinct()
    inputs = specs.groupBy("assistant").agg(F.count(F.lit(1)).alias("unique_inputs"), F.count_if(F.col("author") != "user").alias("model_authored_inputs"))
    counted = studies.groupBy("assistant").agg(F.count(F.lit(1)).alias("studies"))
    return counted.join(inputs, "assistant").select("assistant", "studies", "unique_inputs", "model_authored_inputs", F.col("unique_inputs").alias("message_requests"), (F.col("studies") * 4).alias("probe_requests"))


def suite_violations(studies: DataFrame, authors: list[str], rules: SuiteRules | None = None) -> DataFrame:
    """(assistant, problem): suites with too many or repeated studies, rollouts, authors that were not selected, or
    framings that are missing or unknown."""
    rules = rules or SuiteRules()
    specs = _specs(studies)
    used = specs.groupBy("assistant").agg(F.collect_set("framing").alias("framings"), F.count_if((F.col("author") != rules.author_of_user) & ~F.col("author").isin(*authors)).alias("strangers"))
    shape = studies.groupBy("assistant").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("input1", "input2", "rollouts").alias("different"), F.max("rollouts").alias("rollouts"))
    levels = F.array(*map(F.lit, rules.framings))
    tests = [(F.col("n") > rules.studies, "too many studies"), (F.col("different") < F.col("n"), "repeated studies"), (F.col("rollouts") != 1, "more than one rollout"), (F.col("strangers") > 0, "author not selected")]
    tests += [(F.size(F.array_except(levels, "framings")) > 0, "missing framing"), (F.size(F.array_except("framings", levels)) > 0, "unknown framing")]
    problems = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in tests)))
    return shape.join(used, "assistant").select("assistant", F.explode(problems).alias("problem"))


def instruction_pairs(bank: DataFrame) -> DataFrame:
    """(instruction, pair_id) of a bank; an instruction of two pairs is an error."""
    rows = bank.select("pair_id", F.explode(F.array("first", "second")).alias("instruction"))
    require_empty(rows.groupBy("instruction").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "instructions used twice")
    return rows.select("instruction", "pair_id")


def pair_of_study(studies: DataFrame, bank: DataFrame) -> DataFrame:
    """(study_id, pair_id, problem): the pair of each study, or why there is none."""
    rows = _specs(studies).join(F.broadcast(instruction_pairs(bank)), "instruction", "left")
    found = rows.groupBy("study_id").agg(F.count_if(F.col("pair_id").isNull()).alias("unknown"), F.countDistinct("pair_id").alias("pairs"), F.min("pair_id").alias("pair_id"))
    problem = F.when(F.col("unknown") > 0, "unknown instruction").when(F.col("pairs") > 1, "several pairs")
    return found.select("study_id", F.when(problem.isNull(), F.col("pair_id")).alias("pair_id"), problem.alias("problem"))


def with_pair_ids(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Report rows with the pair of their instruction; an unknown instruction is an error. A bank is small."""
    out = rows.join(F.broadcast(instruction_pairs(bank)), "instruction", "left")
    require_empty(out.where("pair_id IS NULL").select("instruction"), "instructions of no pair")
    return out


def compare_runs(baseline: DataFrame, candidate: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both runs' values by coordinate, and whether any differs. Coordinates must be the same and unique."""
    both = baseline.select(*keys, F.struct(*values).alias("b"), F.lit(1).alias("in_b")).unionByName(candidate.select(*keys, F.struct(*values).alias("b"), F.lit(0).alias("in_b")))
    seen = both.groupBy(*keys).agg(F.sum("in_b").alias("base"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("in_b") == 1, F.col("b"))).alias("b"), F.max(F.when(F.col("in_b") == 0, F.col("b"))).alias("c"))
    require_empty(seen.where("base <> 1 OR n <> 2").select(*keys), "coordinates that are not once in each run")
    columns = [F.col(f"{side}.{v}").alias(f"{name}_{v}") for v in values for side, name in (("b", "baseline"), ("c", "candidate"))]
    return seen.select(*keys, *columns, (~F.col("b").eqNullSafe(F.col("c"))).alias("changed"))


def contexts_to_score(trials: DataFrame, saved: DataFrame, planned: DataFrame) -> DataFrame:
    """(study_id, trial_id, permutation, setup, origin): of each trial the saved setup, or else the planned one of its study
    and permutation, or null where there is neither. Saved setups that differ between rollouts stay apart."""
    rows = trials.select("study_id", "trial_id", "permutation").join(saved.select("trial_id", F.col("setup").alias("saved")), "trial_id", "left")
    rows = rows.join(planned.select("study_id", "permutation", F.col("setup").alias("planned")), ["study_id", "permutation"], "left")
    origin = F.when(F.col("saved").isNotNull(), "saved").when(F.col("planned").isNotNull(), "scheduled").otherwise("missing")
    return rows.select("study_id", "trial_id", "permutation", F.coalesce("saved", "planned").alias("setup"), origin.alias("origin"))


def context_requests(contexts: DataFrame) -> DataFrame:
    """(study_id, permutation, setup, state): each distinct setup once, conflicting ones and missing ones marked."""
    found = contexts.groupBy("study_id", "permutation").agg(F.countDistinct("setup").alias("n"), F.min("setup").alias("setup"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "available").otherwise("conflicting")
    return found.select("study_id", "permutation", F.when(F.col("n") == 1, F.col("setup")).alias("setup"), state.alias("state"))


def normalized_hash(text):
    """SHA-256 of a text in lower case with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def partitioned_dialogues(dialogues: DataFrame, partition: DataFrame, split: str) -> DataFrame:
    """Dialogues of a split of a frozen partition. dialogues: id, split, text; partition: id, split, sha256.

    An id outside the partition, another split than there, another text, or a missing dialogue is an error.
    """
    p = partition.select("id", F.col("split").alias("p_split"), "sha256")
    both = dialogues.join(p, "id", "left")
    wrong = both.where(F.col("p_split").isNull() | (F.col("split") != F.col("p_split")) | ((F.col("split") == split) & (normalized_hash(F.col("text")) != F.col("sha256"))))
    require_empty(wrong.select("id"), "dialogues that do not agree with their partition")
    require_empty(p.where(F.col("p_split") == split).join(dialogues, "id", "left_anti").select("id"), "dialogues that are missing")
    return both.where(F.col("split") == split).drop("p_split", "sha256")
