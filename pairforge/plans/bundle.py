"""A whole analysis: every table from one observation table, checks, and a report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import lasso, ranking, reports, trials
from pairforge.shared import materialize, scratch
from pairforge.sources.files import markdown, write_tables


@dataclass(frozen=True)
class AnalysisConfig:
    fit: ranking.FitConfig = ranking.FitConfig()
    bootstrap: bool = True
    lasso: lasso.LassoConfig | None = field(default_factory=lasso.LassoConfig)


@dataclass
class Analysis:
    """tables by name, the row of checks, and one row an assistant on the sparse model, if it was fitted."""

    tables: dict[str, DataFrame]
    diagnostics: DataFrame
    lasso_diagnostics: DataFrame | None = None


def analyse(obs: DataFrame, bank: DataFrame, cfg: AnalysisConfig | None = None) -> Analysis:
    """All tables of an analysis. Trials, counts by cell, fits and comparisons are computed once and shared.

    Trials are stored once and read four times, to count cells, meetings, pairs and lasso rows. All tables read counts, whose rows the
    design bounds. obs needs pair_id, side, skill and conflict of each row beside its columns.
    """
    cfg, spark = cfg or AnalysisConfig(), obs.sparkSession
    keep = lambda df, name: materialize(spark, df, f"analysis-{name}")[0]
    tried = trials.checked_trials(obs)
    obs = keep(trials.cell_counts(tried), "cells")
    fits = ranking.fit_all(obs, cfg.fit, cfg.bootstrap, compared=trials.comparisons(tried))
    ranked = keep(fits.ranking, "ranking")
    scores = ranked.select("cell_id", "score")
    axis = keep(reports.axis_summary(obs, scores), "axis")
    exclusivity = keep(trials.pair_exclusivity(tried), "exclusivity")
    tables = {
        "cell_ranking": ranked,
        "regularization": ranking.rank_table(fits.fitted),
        "axis_summary": axis,
        "axis_comparisons": reports.axis_comparisons(axis),
        "stratum_summary": reports.stratum_summary(obs),
        "pair_exclusivity": exclusivity,
        "position_summary": reports.position_summary(obs),
        "cell_position_effects": reports.cell_position_effects(obs),
        "axis_position_effects": reports.axis_position_effects(obs),
        "order_sensitivity": reports.order_sensitivity(obs),
        "bank_coverage": reports.bank_coverage(bank),
    }
    found = None
    if cfg.lasso:
        found = lasso.fit_rows(lasso.counted_rows(trials.within(tried, "assistant", "pair_id")), cfg.lasso)
        tables |= {"lasso_path": found["path"], "lasso_features": found["features"], "lasso_blocks": found["blocks"]}
    balance = keep(reports.position_balance(obs), "balance")
    return Analysis(tables, diagnostics(obs, fits, ranked, exclusivity, balance), found and found["diagnostics"])


def diagnostics(obs: DataFrame, fits: ranking.Fits, ranked: DataFrame, exclusivity: DataFrame, balance: DataFrame) -> DataFrame:
    """One row of counts and checks, joined from single-row aggregates; obs are counts by cell, fits.compared has a row a trial."""
    seen = obs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.countDistinct("cell_id").alias("cells"))
    compared = fits.compared.agg(F.count("trial_id").alias("trials"), F.count(F.lit(1)).alias("comparison_count"), F.count_if(F.col("outcome") == 0.5).alias("tie_comparisons"))
    parts = ranking.components_match(obs, fits.cells).select("components", (F.col("components") == 1).alias("comparison_graph_connected"), F.col("components_match").alias("components_match_pair_assistant"))
    both = exclusivity.agg(F.sum("both_completed").cast("long").alias("both_completed_trials"), F.sum("neither_completed").cast("long").alias("neither_completed_trials"))
    balanced = balance.agg(F.min("balanced").alias("position_balanced"), F.count_if(~F.col("balanced")).alias("unbalanced_cells"))
    by_component = ranked.groupBy("component").agg(F.min("converged").alias("c"), F.max("iterations").alias("i"), F.max("objective").alias("o"))
    fit = by_component.agg(F.min("c").alias("fit_converged"), F.max("i").alias("fit_iterations"), F.sum("o").alias("fit_objective"))
    stable = ranking.rank_stability(fits.fitted, fits.l2).agg(F.min("rank_correlation_with_primary").alias("least_rank_correlation"), F.max("max_absolute_rank_shift").alias("greatest_rank_shift"))
    out = seen.join(compared, how="cross").select("observations", "trials", "cells", "comparison_count", "tie_comparisons")
    for row in (parts, both, balanced, fit, stable):
        out = out.join(row, how="cross")
    return out


def report(analysis: Analysis, most: int = 20) -> str:
    """Markdown: the checks, then the head of every table."""
    row = analysis.diagnostics.first().asDict()
    lines = ["# Analysis", "", "## Checks", "", *(f"- {k}: {v:.4f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in row.items()), ""]
    lines += ["Scores and ranks hold within a component only: a trial compares the two instructions of one pair.", ""]
    order = {"cell_ranking": ("component", "rank"), "lasso_features": ("entry_index", "feature")}
    for name, df in analysis.tables.items():
        keys = [c for c in order.get(name, df.columns[:2]) if c in df.columns]
        lines += [f"## {name}", "", markdown(df.orderBy(*(F.asc_nulls_last(c) for c in keys)), most), ""]
    return "\n".join(lines)


def write_analysis(analysis: Analysis, folder: str) -> list[str]:
    """One CSV folder for each table that has rows, diagnostics.json, lasso_diagnostics.json and report.md; returns the tables' names."""
    spark = analysis.diagnostics.sparkSession
    names = write_tables(analysis.tables, folder)
    row = json.dumps(analysis.diagnostics.first().asDict(), sort_keys=True)
    for name, text in (("diagnostics.json", row), ("report.md", report(analysis))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder.rstrip('/')}/{name}", lineSep="\n")
    if analysis.lasso_diagnostics is not None:
        analysis.lasso_diagnostics.coalesce(1).write.json(f"{folder.rstrip('/')}/lasso_diagnostics.json")
    return names


def temporary_folder(spark) -> str:
    return scratch(spark, "analysis")
