"""Content signatures, and the qualification and adoption of probes on content that is held apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.multinomial import ProbeFit, ProbeGridConfig, score_fits
from pairforge.operators.probes import classification_metrics, paired_scores, rates_at, role_accuracies, threshold_calibration
from pairforge.operators.resampling import BootstrapConfig, paired_bootstrap
from pairforge.operators.validate import InvalidData, require_empty
from pairforge.shared import literal, materialize


def content_signatures(tokens: DataFrame, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """(by, tokens, signature): equal for equal sequences of tokens, whatever the ids.

    tokens: by, position (from 0 in its document), token. Each token is hashed with its place; sums and parities of the hashes
    merge in any order, so a document of any length is combined before the shuffle and never gathered.
    """
    one, two = F.xxhash64("position", "token"), F.xxhash64("token", "position", F.lit("second"))
    wide = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    marks = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), wide(one).alias("a"), wide(two).alias("b"), F.bit_xor(one).alias("c"), F.bit_xor(two).alias("d"))
    return marks.select(*by, "tokens", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("tokens", "a", "b", "c", "d"))), 256).alias("signature"))


def shared_content(parts: dict[str, DataFrame]) -> DataFrame:
    """(signature, parts): content that more than one part holds. parts: signatures by the part's name."""
    named = [df.select("signature", F.lit(name).alias("part")) for name, df in sorted(parts.items())]
    everything = reduce(DataFrame.unionByName, named).distinct()
    return everything.groupBy("signature").agg(F.sort_array(F.collect_list("part")).alias("parts")).where(F.size("parts") > 1)


@dataclass(frozen=True)
class Gates:
    """The least figures of a probe that may be used."""

    role_accuracy: float = 0.75
    document_accuracy: float = 0.75
    sensitivity: float = 0.75
    specificity: float = 0.75
    auc: float = 0.85
    auc_above: float = 0.5


def qualification(calibration_pairs: DataFrame, test_pairs: DataFrame, test_tokens: DataFrame, gates: Gates | None = None, bootstrap: BootstrapConfig | None = None, contents: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row: the threshold frozen on calibration pairs, its figures on test pairs, and which gates they pass.

    pairs: conversation, reasoning, final; tokens: document, label, predicted, p. Calibration and test must not share
    a conversation, nor may two of `contents` (signatures of what was trained on, calibrated on and tested on) share content.
    """
    require_empty(calibration_pairs.join(test_pairs, "conversation", "left_semi").select("conversation"), "conversations in calibration and in test")
    if contents:
        require_empty(shared_content(contents), "content that more than one part holds")
    gates, spark = gates or Gates(), test_pairs.sparkSession
    frozen, _ = materialize(spark, threshold_calibration(paired_scores(calibration_pairs)), "calibration")
    at_test = rates_at(paired_scores(test_pairs), frozen)
    metrics = classification_metrics(test_tokens).select("document_accuracy").join(role_accuracies(test_tokens).agg(F.min("accuracy").alias("role_accuracy")), how="cross")
    row = frozen.join(at_test, how="cross").join(metrics, how="cross").join(paired_bootstrap(test_pairs, bootstrap), how="cross")
    segment = (F.col("test_auc") >= gates.auc) & (F.col("lower_95") > gates.auc_above) & (F.col("test_sensitivity") >= gates.sensitivity) & (F.col("test_specificity") >= gates.specificity)
    segment = F.coalesce(F.col("usable") & segment, F.lit(False))
    whole = F.coalesce(segment & (F.col("role_accuracy") >= gates.role_accuracy) & (F.col("document_accuracy") >= gates.document_accuracy), F.lit(False))
    return row.select("threshold", "usable", F.col("auc").alias("calibration_auc"), "test_auc", "lower_95", "upper_95", "test_sensitivity", "test_specificity", "role_accuracy", "document_accuracy", segment.alias("segment_passed"), whole.alias("passed"))


def chosen_candidate(grid: DataFrame) -> tuple[int, float]:
    """(layer, penalty) of the best candidate that converged, by accuracy, smaller loss, greater penalty and smaller layer."""
    best = grid.where("converged").orderBy(F.desc("validation_accuracy"), "validation_loss", F.desc("penalty"), "layer").limit(1).collect()
    if not best:
        raise InvalidData("no candidate of the grid converged")
    return best[0]["layer"], best[0]["penalty"]


ADOPTED = "layer int, penalty double, test_accuracy double, test_loss double, documents long"


def adopt_probe(saved: dict[str, Any], signatures: DataFrame, found: DataFrame, grid: DataFrame, rows: DataFrame) -> DataFrame:
    """ADOPTED, one row: a saved probe is taken over as it is, never fitted again, and judged once on test rows.

    saved: as load_probe returns it, with its penalty in config; signatures: (document, signature) it was trained with, which
    must be those `found` now, document by document; grid: its candidates, whose best must be the saved one; rows: split,
    label, features by layer.
    """
    then, now = (df.select("document", F.col("signature").alias(c)) for df, c in ((signatures, "then"), (found, "now")))
    require_empty(then.join(now, "document", "full").where(~F.col("then").eqNullSafe(F.col("now"))).select("document"), "documents that are not those of the saved probe")
    layer, penalty = chosen_candidate(grid)
    if (saved["layer"], saved["config"].get("penalty")) != (layer, penalty):
        raise InvalidData("the saved probe is not the best candidate of its grid")
    weights = np.asarray(saved["weights"], float)
    test, _ = materialize(rows.sparkSession, rows.where("split = 'test'").select("label", "features"), "adoption")
    ((accuracy, loss),) = score_fits(test, [ProbeFit(layer, penalty, weights, weights)], ProbeGridConfig(len(weights), (penalty,)))
    return literal(rows.sparkSession, [(layer, penalty, float(accuracy), float(loss), found.count())], ADOPTED)
