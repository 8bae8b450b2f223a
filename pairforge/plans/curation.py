"""Curation of a bank of pairs as one job with its report, and the comparison of two prompt runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.observe import cached_pair_checks, failure_reasons
from pairforge.operators.reports import bank_coverage
from pairforge.operators.similar import jaccard_neighbours
from pairforge.operators.validate import InvalidData
from pairforge.shared import materialize
from pairforge.sources.files import markdown

#: The band of difficulties that pass.
EASIEST, HARDEST = 2, 4


def audit(bank: DataFrame, checks: DataFrame) -> DataFrame:
    """(pair_id, skill, conflict, verdict, difficulty, reasons) of every pair: pass, FAIL, or not audited.

    checks: the pair's whole definition, what failure_reasons takes, and issues array<string>; a check of another definition of the
    pair does not count.
    """
    whole = ["pair_id", "skill", "conflict", "first", "second", "rationale"]
    judged = failure_reasons(checks, EASIEST, HARDEST).select(*whole, "passes", "first_difficulty", "second_difficulty", F.concat("reasons", F.coalesce("issues", F.array().cast("array<string>"))).alias("all"))
    both = bank.join(judged, whole, "left")
    verdict = F.when(F.col("passes").isNull(), "not audited").when(F.col("passes"), "pass").otherwise("FAIL")
    difficulty = F.when(F.col("passes").isNotNull(), F.concat_ws(" / ", F.col("first_difficulty").cast("string"), F.col("second_difficulty").cast("string"))).otherwise("")
    return both.select("pair_id", "skill", "conflict", verdict.alias("verdict"), difficulty.alias("difficulty"), F.coalesce(F.array_join("all", "; "), F.lit("")).alias("reasons"))


def overlaps(bank: DataFrame, threshold: float) -> DataFrame:
    """(pair_id, slot, nearest_pair_id, similarity, over): the nearest instruction of another pair; ties by pair, then slot."""
    sides = bank.select("pair_id", F.expr("stack(2, 'first', first, 'second', second) as (slot, text)"))
    texts = sides.select(F.struct("pair_id", "slot").alias("id"), F.col("pair_id").alias("group"), "text")
    near = jaccard_neighbours(texts)
    return near.select("id.pair_id", "id.slot", F.col("neighbour.pair_id").alias("nearest_pair_id"), "similarity", (F.col("similarity") >= threshold).alias("over"))


@dataclass
class Curation:
    """What a curation found. passed: no pair fails, and every one has been audited."""

    bank: DataFrame
    coverage: DataFrame
    audit: DataFrame
    overlaps: DataFrame
    summary: DataFrame

    @property
    def passed(self) -> bool:
        row = self.summary.first()
        return row["failing_pairs"] == 0 and row["audited_pairs"] == row["pairs"]


def curate(bank: DataFrame, checks: DataFrame, threshold: float = 0.5) -> Curation:
    """Coverage, audit and overlaps of a bank, and one row of counts; the audit's rows are computed once."""
    if not 0 <= threshold <= 1:
        raise InvalidData("the threshold of similarity is between 0 and 1")
    spark = bank.sparkSession
    audited, _ = materialize(spark, audit(bank, checks), "audit")
    near, _ = materialize(spark, overlaps(bank, threshold), "overlaps")
    hits = cached_pair_checks(bank, checks).agg(F.count(F.lit(1)).alias("cache_hits"))
    counts = audited.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("verdict") != "not audited").alias("audited_pairs"), F.count_if(F.col("verdict") == "FAIL").alias("failing_pairs"))
    over = near.agg(F.count_if("over").alias("overlapping_instructions"))
    return Curation(bank, bank_coverage(bank), audited, near, counts.join(hits, how="cross").join(over, how="cross").withColumn("threshold", F.lit(threshold)))


def curation_report(found: Curation, most: int = 1000) -> str:
    """Markdown of at most `most` rows a table, for people to look through."""
    row = found.summary.first().asDict()
    lines = ["# Curation of the bank", "", "## Summary", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in row.items()), f"- difficulties that pass: {EASIEST} to {HARDEST}", ""]
    tables = {"Coverage": found.coverage.orderBy("skill", "conflict"), "Audit": found.audit.orderBy("pair_id"), "Overlaps": found.overlaps.orderBy("pair_id", "slot")}
    for name, df in tables.items():
        lines += [f"## {name}", "", markdown(df, most), ""]
    lines += ["## Pairs", ""]
    for r in found.bank.orderBy("pair_id").limit(most).collect():
        lines += [f"### {r['pair_id']}", "", f"{r['skill']}, {r['conflict']}: {r['rationale']}", "", f"First: {r['first']}", "", f"Second: {r['second']}", ""]
    return "\n".join(lines)


def pass_rate(passed: Column, assessed: Column) -> Column:
    """3/4 (75.0%); N/A where nothing was assessed."""
    rate = F.when(assessed == 0, "N/A").otherwise(F.concat(F.format_number(100 * passed / assessed, 1), F.lit("%")))
    return F.concat(passed.cast("string"), F.lit("/"), assessed.cast("string"), F.lit(" ("), rate, F.lit(")"))


def run_comparison(rows: DataFrame) -> DataFrame:
    """(pair_id, judge, baseline, candidate): passed of assessed rows of both runs, by pair and judge, and overall.

    rows: run (baseline or candidate), pair_id, judge, complies; what is null was not assessed, and is no pass. A pair that only one
    run has is 0/0 in the other.
    """
    of = lambda run, c: F.count_if((F.col("run") == run) & c)
    counts = [of(run, c).alias(f"{run}_{n}") for run in ("baseline", "candidate") for n, c in (("passed", F.coalesce("complies", F.lit(False))), ("assessed", F.col("complies").isNotNull()))]
    by_pair = rows.groupBy("pair_id", "judge").agg(*counts)
    overall = by_pair.groupBy(F.lit("Overall").alias("pair_id"), "judge").agg(*(F.sum(c).alias(c) for c in by_pair.columns[2:]))
    cells = [pass_rate(F.col(f"{run}_passed"), F.col(f"{run}_assessed")).alias(run) for run in ("baseline", "candidate")]
    return by_pair.unionByName(overall).select("pair_id", "judge", *cells)
