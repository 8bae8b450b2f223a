"""Rules that are checked while a table is written anyway: no job and no scan of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairforge.operators.validate import InvalidData
from pairforge.shared import materialize, remove


@dataclass(frozen=True)
class Rule:
    """A name, and when a row breaks it; null is not broken."""

    name: str
    broken: Column


def violations(rows: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(rule, keys): one row for every rule that a row breaks, in one scan."""
    broken = F.array_compact(F.array(*(F.when(r.broken, F.lit(r.name)) for r in rules)))
    return rows.select(F.explode(broken).alias("rule"), *keys)


def checked(rows: DataFrame, rules: list[Rule], name: str, keys: tuple[str, ...], keep: list[str] | None = None, least: int = 0) -> DataFrame:
    """Writes rows (the columns `keep` of them) to the shared folder, counting in the same pass how many break each rule.

    If any do, or there are fewer than `least` rows, what was written is removed, and the error names each broken rule with its
    count and the first of its keys.
    """
    spark, seen = rows.sparkSession, Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    for k, r in enumerate(rules):
        metrics += [F.count_if(r.broken).alias(f"n{k}"), F.min(F.when(r.broken, F.to_json(F.struct(*keys)))).alias(f"x{k}")]
    out, path = materialize(spark, rows.observe(seen, *metrics).select(*(keep or rows.columns)), name)
    got = seen.get
    broken = [f"{r.name}: {got[f'n{k}']}, such as {got[f'x{k}']}" for k, r in enumerate(rules) if got[f"n{k}"]]
    if not broken and got["rows"] < least:
        broken = [f"{got['rows']} rows where at least {least} are needed"]
    if broken:
        remove(spark, path)
        raise InvalidData("; ".join(broken))
    return out


def observation_rules(cell: Column) -> list[Rule]:
    """What every observation fulfils; `cell` is the id of its coordinates."""
    return [
        Rule("cell ids that do not match their coordinates", F.col("cell_id") != cell),
        Rule("rollouts below one", F.col("rollout") < 1),
        Rule("permutations other than 1 and 2", ~F.col("permutation").isin(1, 2)),
        Rule("positions other than 1 and 2", ~F.col("position").isin(1, 2)),
    ]


def trial_rules() -> list[Rule]:
    """What every trial fulfils, on a row a trial with rows, lo and hi of its positions and its cells' ids a and b."""
    return [
        Rule("trials that are not two rows", F.col("rows") != 2),
        Rule("trials whose positions are not 1 and 2", (F.col("lo") != 1) | (F.col("hi") != 2)),
        Rule("trials that hold one cell twice", F.col("first") == F.col("second")),
    ]
