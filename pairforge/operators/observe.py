"""Building observations from trials, traces and judgments; resuming; upserts; audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.text import cell_id, jaccard, response_id, word_set
from pairforge.operators.validate import require_empty
from pairforge.shared import dealt, materialize, unused

SPEC = ("instruction", "framing", "channel", "author")


def missing(trials: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Trials without a saved row: the work that is left."""
    return trials.join(saved.select(*keys), keys, "left_anti")


def hits(trials: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    return trials.join(saved.select(*keys), keys, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old by key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def reusable_judgments(traces: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments whose trace has not changed since."""
    return judgments.join(traces.select("trial_id", "trace_fingerprint"), ["trial_id", "trace_fingerprint"], "left_semi")


def traces_to_judge(traces: DataFrame, judgments: DataFrame) -> DataFrame:
    return traces.join(judgments.select("trial_id", "trace_fingerprint"), ["trial_id", "trace_fingerprint"], "left_anti")


def observations(trials: DataFrame, traces: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row per trial and input, in the observation schema.

    trials: trial_id, permutation, rollout, assistant, input1, input2; traces: trial_id,
    trace_fingerprint, payload; judgments: trial_id, trace_fingerprint, payload, verdicts array<boolean>.
    A judgment of another trace is an error.
    """
    t = traces.select("trial_id", "trace_fingerprint", response_id(F.col("payload")).alias("assistant_response_id"))
    j = judgments.select("trial_id", F.col("trace_fingerprint").alias("judged"), "verdicts", response_id(F.col("payload")).alias("judge_response_id"))
    joined, _ = materialize(trials.sparkSession, trials.join(t, "trial_id").join(j, "trial_id"), "joined")
    require_empty(joined.where((F.col("judged") != F.col("trace_fingerprint")) | (F.size("verdicts") != 2)).select("trial_id"), "judgment does not match its trace")
    rows = joined.select("*", F.posexplode(F.array("input1", "input2")).alias("at", "spec"))
    spec = [F.col(f"spec.{c}") for c in SPEC]
    return rows.select(
        "trial_id",
        cell_id(*spec, F.col("assistant")).alias("cell_id"),
        *spec,
        "assistant",
        "permutation",
        "rollout",
        (F.col("at") + 1).alias("position"),
        F.element_at("verdicts", F.col("at") + 1).alias("completed"),
        "trace_fingerprint",
        "assistant_response_id",
        "judge_response_id",
    )


def default_judgments(traces: DataFrame) -> DataFrame:
    """Traces that did not complete count as two failures without a judge."""
    return traces.where(F.col("terminal_status") != "completed").select("trial_id", "trace_fingerprint", F.array(F.lit(False), F.lit(False)).alias("verdicts"), F.lit(None).cast("string").alias("judge_response_id"))


def failed_trials(traces: DataFrame) -> DataFrame:
    return traces.where(F.col("terminal_status") != "completed")


def specs_to_write(studies: DataFrame, saved: DataFrame) -> DataFrame:
    """Distinct specifications of the studies for which no message is saved."""
    specs = studies.select(F.explode(F.array("input1", "input2")).alias("s")).select("s.*").distinct()
    return specs.join(saved.select(*SPEC), list(SPEC), "left_anti")


def without_rejected(studies: DataFrame, rejected: DataFrame) -> DataFrame:
    """Studies neither of whose inputs is rejected."""
    sides = studies.select("study_id", F.explode(F.array("input1", "input2")).alias("s")).select("study_id", "s.*")
    return studies.join(sides.join(rejected.select(*SPEC), list(SPEC), "left_semi").select("study_id"), "study_id", "left_anti")


def audit_split(messages: DataFrame, audited: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages already audited, those still to audit, and specifications with conflicting contents.

    Messages are counted first and dealt by specification, so no task sorts more than a fixed number of them; specifications are stored once.
    """
    n = messages.count()
    by_spec = dealt(messages.select(*SPEC, "content"), n, *SPEC).groupBy(*SPEC).agg(F.min("content").alias("content"), F.max("content").alias("other"))
    by_spec, _ = materialize(messages.sparkSession, by_spec, "specifications")
    conflicts = by_spec.where("content <> other").select(*SPEC)
    keys = [*SPEC, "content"]
    single, known = dealt(by_spec.where("content = other").select(*keys), n, *keys), dealt(audited.select(*keys), n, *keys)
    return single.join(known, keys, "left_semi"), single.join(known, keys, "left_anti"), conflicts


def cached_pair_checks(bank: DataFrame, checks: DataFrame) -> DataFrame:
    """Pairs whose whole definition was checked before."""
    keys = ["pair_id", "skill", "conflict", "first", "second", "rationale"]
    return bank.join(checks.select(*keys), keys, "left_semi")


def saved_contexts(studies: DataFrame, contexts: DataFrame) -> DataFrame:
    """(study_id, state): missing, available or conflicting, by how many setups were saved."""
    counted = contexts.groupBy("study_id").agg(F.countDistinct("setup").alias("n"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") == 1, "available").otherwise("conflicting")
    return studies.select("study_id").join(counted, "study_id", "left").select("study_id", state.alias("state"))


def provenance_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def failure_reasons(checks: DataFrame, easiest: int = 2, hardest: int = 4) -> DataFrame:
    """Checks with the reasons against them, in order, and whether there are none.

    checks: first_feasible, first_difficulty, second_feasible, second_difficulty, requires_tools,
    mutually_exclusive.
    """
    tests = []
    for side in ("first", "second"):
        level = F.col(f"{side}_difficulty")
        tests += [F.when(~F.col(f"{side}_feasible"), F.lit(f"{side} instruction is not feasible")), F.when(~level.between(easiest, hardest), F.concat(F.lit(f"{side} instruction difficulty "), level.cast("string")))]
    tests += [F.when(~F.col("requires_tools"), F.lit("neither instruction requires tools")), F.when(~F.col("mutually_exclusive"), F.lit("instructions are not mutually exclusive"))]
    return checks.withColumn("reasons", F.array_compact(F.array(*tests))).withColumn("passes", F.size("reasons") == 0)


def similarity(first: str, second: str):
    return jaccard(word_set(F.col(first)), word_set(F.col(second)))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last saved row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def delivered_provenance(delivered: DataFrame, cached: DataFrame) -> DataFrame:
    """Provenance of cached messages that were delivered as they are, once per specification."""
    return cached.join(delivered.select(*SPEC, "content").distinct(), [*SPEC, "content"], "left_semi").dropDuplicates(list(SPEC))


def score_requests(requests: DataFrame, scorer, schema: str, part: int = 10_000) -> DataFrame:
    """Rows of scorer(pandas frame) of one assistant's requests; if it fails, one error row per request instead.

    Requests are counted first: an assistant's are scored in parts of about `part` by hash, so none grows with the table; a
    failure is that of its part. The schema needs an error column; the others are null in error rows.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    chunk, parts, who = (unused(requests, n) for n in ("chunk", "parts", "who"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=chunk)
        try:
            out = scorer(rows)
            return (out if "error" in out else out.assign(error=None)).reindex(columns=names)
        except Exception as failure:  # the failure is the result of these requests
            return rows.reindex(columns=names).assign(error=str(failure))

    counts = requests.groupBy(F.col("assistant").alias(who)).agg(F.ceil(F.count(F.lit(1)) / part).alias(parts))
    dealt = requests.join(counts, F.col("assistant").eqNullSafe(F.col(who)))
    dealt = dealt.select(*requests.columns, F.pmod(F.xxhash64(*requests.columns), F.col(parts)).alias(chunk))
    return dealt.groupBy("assistant", chunk).applyInPandas(run, schema)


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First occurrences of the keys with their place in the given order."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_at"))


def input_counts(specs: DataFrame, rejected: DataFrame, axes: tuple[str, ...] = SPEC) -> DataFrame:
    """Distinct inputs and how many of them are rejected, by axis value."""
    bad = rejected.select(*SPEC).distinct().withColumn("bad", F.lit(1))
    rows = specs.select(*SPEC).distinct().join(bad, list(SPEC), "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    return rows.unpivot(["bad"], list(axes), "axis", "value").groupBy("axis", "value").agg(F.count(F.lit(1)).alias("inputs"), F.sum("bad").cast("long").alias("failed_inputs"))
