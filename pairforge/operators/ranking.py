"""Pairwise comparisons and penalized Bradley-Terry ranking within components.

The likelihood of a component depends on its comparisons only through how often two cells met and
with what total outcome, so trials are aggregated in Spark before any fit: a task holds cells and
their meetings, which the design bounds, not trials. For the bootstrap, resampling trials is drawing
multinomial counts of (component, two cells, outcome), which has the same distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.stats import sigmoid
from pairforge.operators.checks import checked, trial_rules
from pairforge.operators.graph import component_index, components, cumulative
from pairforge.operators.reports import outcome, tally
from pairforge.operators.resampling import drawn_within
from pairforge.shared import literal, materialize, ship

RANK_DIGITS = 12
COMPARED = ["trial_id", "first", "second", "outcome"]


@dataclass(frozen=True)
class FitConfig:
    l2: float = 1.0
    tolerance: float = 1e-10
    iterations: int = 100
    bootstrap: int = 200
    seed: int = 0
    chunk: int = 25


def _trials(obs: DataFrame) -> DataFrame:
    """A row a trial: its cells in id order, the outcome, and what its checks look at."""
    side = F.struct("cell_id", "completed")
    facts = [F.count(F.lit(1)).alias("rows"), F.min("position").alias("lo"), F.max("position").alias("hi")] if "position" in obs.columns else []
    out = obs.groupBy("trial_id").agg(F.min(side).alias("a"), F.max(side).alias("b"), *facts)
    return out.select("trial_id", F.col("a.cell_id").alias("first"), F.col("b.cell_id").alias("second"), outcome().alias("outcome"), *(["rows", "lo", "hi"] if facts else []))


def comparisons(obs: DataFrame) -> DataFrame:
    """(trial_id, first, second, outcome): cells in id order, outcome 1, 0 or a half for a tie."""
    return _trials(obs).select(*COMPARED)


def checked_comparisons(obs: DataFrame) -> DataFrame:
    """comparisons, stored; a trial that is not two cells at positions 1 and 2 is an error, found in the same pass."""
    return checked(_trials(obs), trial_rules(), "comparisons", ("trial_id",), COMPARED)


def cell_components(obs: DataFrame, compared: DataFrame) -> DataFrame:
    """(cell_id, component) with components numbered by their smallest cells."""
    edges = compared.select(F.col("first").alias("a"), F.col("second").alias("b"))
    labels, _ = materialize(obs.sparkSession, components(obs.select(F.col("cell_id").alias("node")).distinct(), edges), "cells")
    return component_index(labels).select(F.col("node").alias("cell_id"), "component")


def components_match(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: whether every component is one (pair, assistant) block and no block has two."""
    blocks = obs.select("cell_id", "pair_id", "assistant").distinct().join(cells, "cell_id").select("component", "pair_id", "assistant").distinct()
    counts = blocks.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("component").alias("components"), F.countDistinct("pair_id", "assistant").alias("blocks"))
    return counts.select("components", "blocks", ((F.col("pairs") == F.col("components")) & (F.col("blocks") == F.col("components"))).alias("components_match"))


def counted(compared: DataFrame) -> DataFrame:
    """(first, second, outcome, n): trials counted by what the likelihood needs."""
    return compared.groupBy("first", "second", "outcome").agg(F.count(F.lit(1)).alias("n"))


def meetings(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(component, first, second, outcome, n) of counted trials."""
    return counts.join(cells.withColumnRenamed("cell_id", "first"), "first").select("component", "first", "second", "outcome", "n")


@dataclass
class Fit:
    scores: np.ndarray
    errors: np.ndarray | None
    objective: float
    converged: bool
    iterations: int


def _logistic(d: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(d))
    return np.where(d >= 0, 1.0, e) / (1.0 + e)


def fit_component(size: int, first: np.ndarray, second: np.ndarray, met: np.ndarray, won: np.ndarray, cfg: FitConfig, errors: bool = True) -> Fit:
    """Newton's method for l2/2 |s|^2 + sum of met * log(1 + e^d) - won * d with d = s[first] - s[second].

    Scores are centred on zero after every step.
    """
    s, done, steps, place = np.zeros(size), False, 0, first * size + second

    def hessian(p: np.ndarray) -> np.ndarray:
        w = met * p * (1.0 - p)
        h = -np.bincount(place, w, size * size).reshape(size, size)
        h += h.T
        h[np.arange(size), np.arange(size)] = cfg.l2 - h.sum(1)
        return h

    while steps < cfg.iterations and not done:
        steps += 1
        p = _logistic(s[first] - s[second])
        pull = met * p - won
        gradient = np.bincount(first, pull, size) - np.bincount(second, pull, size) + cfg.l2 * s
        move = np.linalg.solve(hessian(p), gradient)
        new = s - move
        new -= new.mean()
        done = bool(np.abs(new - s).max() < cfg.tolerance)
        s = new
    d = s[first] - s[second]
    objective = 0.5 * cfg.l2 * float(s @ s) + float((met * np.logaddexp(0.0, d) - won * d).sum())
    spread = np.sqrt(np.diag(np.linalg.inv(hessian(_logistic(d))))) if errors else None
    return Fit(s, spread, objective, done, steps)


def _arrays(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    cells = sorted(set(rows["first"]) | set(rows["second"]))
    place = {c: i for i, c in enumerate(cells)}
    return cells, rows["first"].map(place).to_numpy(np.int64), rows["second"].map(place).to_numpy(np.int64)


def _pairs(size: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of cells and the place of each row among them: a fit sees a pair once, whatever its outcomes."""
    found, at = np.unique(first * size + second, return_inverse=True)
    return found // size, found % size, at


FITTED = "l2 double, component int, cell_id string, score double, standard_error double, rank_in int, converged boolean, iterations int, objective double"


def _fit_kernel(cfg: FitConfig):
    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        l2, component = float(key[0]), int(key[1])
        cells, first, second = _arrays(rows)
        n = rows["n"].to_numpy(float)
        first, second, at = _pairs(len(cells), first, second)
        fit = fit_component(len(cells), first, second, np.bincount(at, n), np.bincount(at, n * rows["outcome"].to_numpy(float)), FitConfig(l2, cfg.tolerance, cfg.iterations))
        order = sorted(range(len(cells)), key=lambda i: (-round(float(fit.scores[i]), RANK_DIGITS), cells[i]))
        rank = np.empty(len(cells), np.int64)
        rank[order] = np.arange(1, len(cells) + 1)
        return pd.DataFrame({"l2": l2, "component": component, "cell_id": cells, "score": fit.scores, "standard_error": fit.errors, "rank_in": rank.astype(np.int32), "converged": fit.converged, "iterations": fit.iterations, "objective": fit.objective})

    return run


def _dealt(tasks: DataFrame, *keys: str) -> DataFrame:
    """Groups in a fixed number of parts, some for each core: their bytes are few and their work is not, so adaptive execution would put
    most of them into one task."""
    return tasks.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism, *keys)


def fit_scores(met: DataFrame, penalties: list[float], cfg: FitConfig) -> DataFrame:
    """Fits of every component under every penalty, one task group each."""
    spark = met.sparkSession
    ship(spark)
    grid = literal(spark, [(float(x),) for x in penalties], "l2 double")
    tasks = met.join(F.broadcast(grid), how="cross")
    return _dealt(tasks, "l2", "component").groupBy("l2", "component").applyInPandas(_fit_kernel(cfg), FITTED)


def _bootstrap_kernel(cfg: FitConfig):
    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        component, chunk = int(key[0]), int(key[1])
        rows = rows.sort_values(["first", "second", "outcome"])
        cells, first, second = _arrays(rows)
        n, outcome = rows["n"].to_numpy(float), rows["outcome"].to_numpy(float)
        lo, hi = chunk * cfg.chunk, min(cfg.bootstrap, (chunk + 1) * cfg.chunk)
        first, second, at = _pairs(len(cells), first, second)
        totals = drawn_within(int(rows["before_n"].iloc[0]), int(n.sum()), int(rows["trials"].iloc[0]), cfg.seed, lo, hi)
        out = []
        for b, total in zip(range(lo, hi), totals, strict=True):
            draw = np.random.default_rng([cfg.seed, b, component]).multinomial(int(total), n / n.sum()).astype(float)
            fit = fit_component(len(cells), first, second, np.bincount(at, draw), np.bincount(at, draw * outcome), cfg, errors=False)
            out.append(pd.DataFrame({"replicate": b, "component": component, "total": total, "cell_id": cells, "score": fit.scores}))
        return pd.concat(out) if out else pd.DataFrame({"replicate": [], "component": [], "total": [], "cell_id": [], "score": []})

    return run


def bootstrap_scores(met: DataFrame, cfg: FitConfig) -> DataFrame:
    """(replicate, component, total, cell_id, score): fits of resampled trials, and how many of them fell on the component.

    Trials are resampled over all components. Each task draws its own component's total: components are ranges of trials, in
    a tree of conditional binomials, so the totals of a replicate add up to the number of trials.
    """
    spark = met.sparkSession
    ship(spark)
    sizes, _ = materialize(spark, met.groupBy("component").agg(F.sum("n").alias("n")), "component-trials")
    ranges = cumulative(sizes, "component", ["n"]).join(sizes.agg(F.sum("n").alias("trials")), how="cross").select("component", "before_n", "trials")
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-cfg.bootstrap // cfg.chunk) - 1))).alias("chunk")
    return _dealt(met.join(ranges, "component").select("*", chunks), "component", "chunk").groupBy("component", "chunk").applyInPandas(_bootstrap_kernel(cfg), "replicate int, component int, total long, cell_id string, score double")


def bootstrap_intervals(met: DataFrame, cfg: FitConfig) -> DataFrame:
    """(cell_id, bootstrap_low, bootstrap_high): percentile intervals over resampled trials."""
    q = bootstrap_scores(met, cfg).groupBy("cell_id").agg(F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("cell_id", F.col("q")[0].alias("bootstrap_low"), F.col("q")[1].alias("bootstrap_high"))


@dataclass
class Fits:
    """Everything that is fitted for an analysis, from one table of comparisons."""

    l2: float
    compared: DataFrame
    cells: DataFrame
    fitted: DataFrame
    ranking: DataFrame


def fit_all(obs: DataFrame, cfg: FitConfig | None = None, bootstrap: bool = False, penalties: tuple[float, ...] = (0.1, 1.0, 10.0), compared: DataFrame | None = None) -> Fits:
    """Comparisons, components, fits at multiples of the penalty, and the ranking at the penalty itself.

    Where comparisons are given, they are taken as checked, and obs may be counts by cell. Trials are counted once, and all else is
    computed from the counts.
    """
    cfg, spark = cfg or FitConfig(), obs.sparkSession
    compared = checked_comparisons(obs) if compared is None else compared
    counts, _ = materialize(spark, counted(compared), "counted")
    cells = cell_components(obs, counts)
    met, _ = materialize(spark, meetings(counts, cells), "meetings")
    fitted, _ = materialize(spark, fit_scores(met, sorted({cfg.l2 * x for x in penalties} | {cfg.l2}), cfg), "fits")
    n, k = tally(obs, "observations", "completions")
    by_cell = obs.groupBy("cell_id", "instruction", "framing", "channel", "author", "assistant", "pair_id", "side", "skill", "conflict").agg(k, n)
    out = by_cell.join(fitted.where(F.col("l2") == cfg.l2), "cell_id").withColumnRenamed("rank_in", "rank").withColumn("completion_rate", F.col("completions") / F.col("observations"))
    if bootstrap:
        out = out.join(bootstrap_intervals(met, cfg), "cell_id", "left")
    else:
        out = out.withColumn("bootstrap_low", F.lit(None).cast("double")).withColumn("bootstrap_high", F.lit(None).cast("double"))
    return Fits(cfg.l2, compared, cells, fitted, out)


def ranking(obs: DataFrame, cfg: FitConfig | None = None, bootstrap: bool = False) -> DataFrame:
    """Rank, score, error, completions and (on request) bootstrap interval of every cell."""
    return fit_all(obs, cfg, bootstrap, (1.0,)).ranking


def rank_table(fitted: DataFrame) -> DataFrame:
    return fitted.select("l2", "component", "cell_id", "score", F.col("rank_in").alias("rank"))


def rank_stability(fitted: DataFrame, l2: float) -> DataFrame:
    """(l2, rank_correlation_with_primary, max_absolute_rank_shift) of each penalty against the primary."""
    primary = fitted.where(F.col("l2") == l2).select("cell_id", F.col("rank_in").cast("double").alias("p"))
    both = fitted.join(primary, "cell_id").withColumn("r", F.col("rank_in").cast("double"))
    corr = F.try_divide(F.covar_pop("p", "r"), F.stddev_pop("p") * F.stddev_pop("r"))
    return both.groupBy("l2").agg(F.when(F.count(F.lit(1)) == 1, 1.0).otherwise(corr).alias("rank_correlation_with_primary"), F.max(F.abs(F.col("p") - F.col("r"))).cast("int").alias("max_absolute_rank_shift"))


def l2_sensitivity(obs: DataFrame, cfg: FitConfig | None = None) -> DataFrame:
    """rank_stability at a tenth, once and ten times l2."""
    cfg = cfg or FitConfig()
    return rank_stability(fit_all(obs, cfg).fitted, cfg.l2)


def stationarity(obs: DataFrame, fits: Fits) -> DataFrame:
    """(component, largest gradient, mean score) of the fits at the primary penalty: how far from a centred optimum."""
    s = fits.fitted.where(F.col("l2") == fits.l2).select("cell_id", "component", "score")
    side = lambda c, name: s.select(F.col("cell_id").alias(c), F.col("score").alias(name))
    pair = fits.compared.join(side("first", "s1"), "first").join(side("second", "s2"), "second")
    pull = sigmoid(F.col("s1") - F.col("s2")) - F.col("outcome")
    ends = pair.select(F.explode(F.array(F.struct(F.col("first").alias("cell_id"), pull.alias("g")), F.struct(F.col("second").alias("cell_id"), (-pull).alias("g")))).alias("x")).select("x.*")
    total = s.join(ends.groupBy("cell_id").agg(F.sum("g").alias("g")), "cell_id", "left")
    gradient = F.coalesce("g", F.lit(0.0)) + fits.l2 * F.col("score")
    return total.groupBy("component").agg(F.max(F.abs(gradient)).alias("largest_gradient"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("cells"))


def diagnostics(obs: DataFrame, fitted: DataFrame, compared: DataFrame) -> dict:
    """Counts and checks of an analysis, from single-row aggregates."""
    rows = obs.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("trial_id").alias("trials"), F.countDistinct("cell_id").alias("cells")).first().asDict()
    rows |= compared.agg(F.count(F.lit(1)).alias("comparison_count"), F.count_if(F.col("outcome") == 0.5).alias("tie_comparisons")).first().asDict()
    by_component = fitted.groupBy("component").agg(F.min("converged").alias("converged"), F.max("iterations").alias("iterations"), F.max("objective").alias("objective"))
    rows |= by_component.agg(F.count(F.lit(1)).alias("components"), F.min("converged").alias("fit_converged"), F.max("iterations").alias("fit_iterations"), F.sum("objective").alias("fit_objective")).first().asDict()
    return rows | {"comparison_graph_connected": rows["components"] == 1}


def ranked_order(fitted: DataFrame) -> DataFrame:
    """Ranks within components by window, where scores are already rounded."""
    order = Window.partitionBy("component").orderBy(F.desc(F.round("score", RANK_DIGITS)), "cell_id")
    return fitted.withColumn("rank", F.row_number().over(order))
