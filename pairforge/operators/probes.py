"""Classifier and threshold statistics of probes."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.stats import softmax
from pairforge.functions.text import fixed
from pairforge.operators.graph import cumulative
from pairforge.schema import AxisOrder
from pairforge.shared import literal, materialize


def probe_expectation(framing: Column, order: AxisOrder | None = None) -> Column:
    order = order or AxisOrder()
    return F.when(framing.isin(*order.reasoning), "reasoning").when(framing.isin(*order.descriptive), "descriptive").otherwise("nonreasoning")


def decision(expectation: Column, probability: Column, threshold: Column, below: Column | None = None) -> Column:
    """Whether a probability is as expected; null where nothing is expected.

    With `below`, what is not reasoning is held against that threshold instead.
    """
    return F.when(expectation == "reasoning", probability >= threshold).when(expectation == "nonreasoning", probability < (threshold if below is None else below))


def decide(rows: DataFrame, threshold: float, by_channel: DataFrame | None = None) -> DataFrame:
    """Adds complies and issue. rows: expectation, channel, probability; by_channel: channel, reasoning_minimum,
    nonreasoning_maximum, which replace the threshold in their channel; channels are few, so it is broadcast."""
    if by_channel is not None:
        rows = rows.join(F.broadcast(by_channel.select("channel", "reasoning_minimum", "nonreasoning_maximum")), "channel", "left")
    else:
        rows = rows.withColumns({"reasoning_minimum": F.lit(None).cast("double"), "nonreasoning_maximum": F.lit(None).cast("double")})
    low, high = (F.coalesce(c, F.lit(float(threshold))) for c in ("reasoning_minimum", "nonreasoning_maximum"))
    complies = decision(F.col("expectation"), F.col("probability"), low, high)
    used = F.when(F.col("expectation") == "reasoning", low).otherwise(high)
    issue = F.when(~complies, F.concat(F.lit("mean probability "), fixed(F.col("probability").cast("double")), F.lit(" conflicts with "), "expectation", F.lit(" at threshold "), fixed(used)))
    return rows.withColumn("complies", complies).withColumn("issue", issue).drop("reasoning_minimum", "nonreasoning_maximum")


def split_counts(n: int, shares: tuple[float, ...]) -> list[int]:
    """Whole sizes of parts: at least one each where n allows, then by the largest remainders."""
    exact = [n * s for s in shares]
    sizes = [max(1, int(x)) for x in exact] if n >= len(shares) else [n, *[0] * (len(shares) - 1)]
    rest = lambda k: exact[k] - sizes[k]
    for _ in range(sum(sizes) - n):
        sizes[min((k for k, size in enumerate(sizes) if size > 1), key=rest)] -= 1
    for _ in range(n - sum(sizes)):
        sizes[max(range(len(sizes)), key=rest)] += 1
    return sizes


def floor_counts(n: int, shares: tuple[float, ...]) -> list[int]:
    """Whole sizes of parts: each share rounded down, and what is left for the last."""
    sizes = [math.floor(n * Fraction(str(s))) for s in shares[:-1]]
    return [*sizes, n - sum(sizes)]


def hash_split(documents: DataFrame, id_col: str, seed: int, shares: tuple[float, float] = (0.8, 0.1), counts: Callable[[int, tuple[float, ...]], list[int]] = split_counts) -> DataFrame:
    """(id, split): train, validation and test by the order of the documents' hashes, in sizes by `counts`.

    With split_counts every part has a document while there are three. The ranks come from a range-partitioned sort:
    counts of the partitions give each its first rank, so no task holds all rows.
    """
    spark = documents.sparkSession
    key = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col("id").cast("string")), 256)
    ids = documents.select(F.col(id_col).alias("id")).distinct().withColumn("h", key)
    n = ids.count()
    train, validation, _ = counts(n, (*shares, 1 - shares[0] - shares[1]))
    bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    ids = ids.withColumn("bucket", bucket)
    sizes = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()  # at most 4096 rows
    start, rows = 0, []
    for r in sizes:
        rows.append((r["bucket"], start))
        start += r["n"]
    offsets = literal(spark, rows, "bucket int, before long")
    ranked = ids.join(F.broadcast(offsets), "bucket").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h")))
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + validation, "validation").otherwise("test")
    return ranked.select("id", split.alias("split"))


def predict(scores: Column) -> Column:
    """Index of the largest probability and the probabilities."""
    p = softmax(scores)
    return F.struct((F.array_position(p, F.array_max(p)) - 1).cast("int").alias("label"), p.alias("p"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Token accuracy, mean of documents' accuracies, and mean loss. rows: document, label, predicted, p."""
    loss = -F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), F.col("p"))))
    by_document = rows.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("k"), F.sum(loss).alias("loss"))
    return by_document.agg(F.sum("n").alias("tokens"), (F.sum("k") / F.sum("n")).alias("token_accuracy"), F.avg(F.col("k") / F.col("n")).alias("document_accuracy"), (F.sum("loss") / F.sum("n")).alias("negative_log_likelihood"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def segment_means(rows: DataFrame) -> DataFrame:
    """Mean probability of each conversation and role."""
    return rows.groupBy("conversation", "role").agg(F.avg("probability").alias("probability"))


def score_steps(rows: DataFrame) -> DataFrame:
    """Distinct scores with pos, neg, what lies below (before_pos, before_neg) and the next score. rows: score, positive."""
    by_score = rows.groupBy("score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    by_score, _ = materialize(rows.sparkSession, by_score, "scores")
    return cumulative(by_score, "score", ["pos", "neg"])


def _auc(pos: str = "pos", neg: str = "neg") -> list[Column]:
    wins = F.sum(F.col(pos) * (F.col(f"before_{neg}") + F.col(neg) / 2))
    return [F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"), F.try_divide(wins, (F.sum(pos) * F.sum(neg)).cast("double")).alias("auc")]


def pooled_auc(rows: DataFrame) -> DataFrame:
    """AUC of score for positive against negative rows, ties a half, by ranks instead of all pairs.

    Equal scores are counted together first; running counts are taken within ranges of scores.
    """
    return score_steps(rows).agg(*_auc())


def paired_concordance(rows: DataFrame) -> DataFrame:
    """Share of conversations whose reasoning score is the higher, ties a half."""
    c = F.when(F.col("reasoning") > F.col("final"), 1.0).when(F.col("reasoning") == F.col("final"), 0.5).otherwise(0.0)
    return rows.agg(F.avg(c).alias("concordance"))


def threshold_calibration(rows: DataFrame) -> DataFrame:
    """One row: the threshold with the best (balanced accuracy, smaller of both rates, threshold), the rates, the AUC and
    how many candidates there are; not usable, and null, if the AUC is no more than a half or nothing tells rows apart.

    Between neighbouring scores both rates are constant, so of each gap the largest candidate counts:
    the upper score itself. Candidates that call all rows alike are left out.
    """
    steps, _ = materialize(rows.sparkSession, score_steps(rows), "steps")
    total = steps.agg(*_auc(), F.count(F.lit(1)).alias("scores"), F.count_if((F.col("score").cast("double") + F.col("following")) / 2 > F.col("score")).alias("middles"))
    c = steps.join(F.broadcast(total.select("positives", "negatives", "auc")), how="cross")
    tp, tn = F.col("positives") - F.col("before_pos"), F.col("before_neg")
    c = c.where((F.col("before_pos") + F.col("before_neg") > 0) & (F.col("auc") > 0.5))
    c = c.select(F.col("score").alias("threshold"), (tp / F.col("positives")).alias("sensitivity"), (tn / F.col("negatives")).alias("specificity"))
    c = c.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    best = c.orderBy(F.desc("balanced_accuracy"), F.desc(F.least("sensitivity", "specificity")), F.desc("threshold")).limit(1)
    count = F.when(F.col("scores") > 0, F.col("scores") + F.col("middles") + 2).otherwise(F.lit(0))
    out = total.select("auc", count.alias("candidate_count")).join(best, how="left")
    return out.select("threshold", "auc", "balanced_accuracy", "sensitivity", "specificity", "candidate_count", F.col("threshold").isNotNull().alias("usable"))


def rates_at(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Sensitivity and specificity of a calibration's threshold on other rows. rows: score, positive."""
    both = rows.join(F.broadcast(calibration.select("threshold")), how="cross")
    up = F.col("score") >= F.col("threshold")
    return both.agg(F.try_divide(F.count_if(F.col("positive") & up), F.count_if("positive")).alias("test_sensitivity"), F.try_divide(F.count_if(~F.col("positive") & ~up), F.count_if(~F.col("positive"))).alias("test_specificity"))


def paired_scores(pairs: DataFrame) -> DataFrame:
    """conversation, reasoning, final -> score, positive."""
    return pairs.select(F.explode(F.array(F.struct(F.col("reasoning").cast("double").alias("score"), F.lit(True).alias("positive")), F.struct(F.col("final").cast("double").alias("score"), F.lit(False).alias("positive")))).alias("x")).select("x.score", "x.positive")


def role_accuracies(rows: DataFrame) -> DataFrame:
    """(label, accuracy, document_accuracy): share of right tokens of each role, over all and as mean of documents' shares."""
    by_document = rows.groupBy("label", "document").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("k"))
    return by_document.groupBy("label").agg((F.sum("k") / F.sum("n")).alias("accuracy"), F.avg(F.col("k") / F.col("n")).alias("document_accuracy"))


def probe_report(rows: DataFrame, axis: str) -> DataFrame:
    """Scores, directional scores, mismatches and errors by an axis, and masked tokens if there are any.

    rows: axis, complies, error, and possibly masked.
    """
    masked = [F.coalesce(F.sum("masked"), F.lit(0)).cast("long").alias("masked")] if "masked" in rows.columns else []
    return rows.groupBy(axis).agg(F.count_if(F.col("error").isNull()).alias("scores"), F.count("complies").alias("directional"), F.count_if(~F.col("complies")).alias("mismatches"), F.count("error").alias("errors"), *masked)


def probe_reports(rows: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """probe_report of several axes in one pass: axis, value and the counts."""
    return probe_report(rows.unpivot(["complies", "error", "masked"], [F.col(a).cast("string").alias(a) for a in axes], "axis", "value").withColumn("key", F.struct("axis", "value")), "key").select("key.axis", "key.value", "scores", "directional", "mismatches", "errors", "masked")


def judge_totals(rows: DataFrame) -> DataFrame:
    """Passes over judged rows, those missing, descriptive and in error. rows: complies, expectation, error."""
    directional = F.col("expectation") != "descriptive"
    return rows.agg(F.count_if(directional & F.col("complies")).alias("passed"), F.count_if(directional & F.col("complies").isNotNull()).alias("judged"), F.count_if(directional & F.col("complies").isNull() & F.col("error").isNull()).alias("missing"), F.count_if(~directional).alias("descriptive"), F.count("error").alias("errors"))


def project_role(rows: DataFrame) -> DataFrame:
    """Mean role probabilities and the likeliest role of each segment. rows: segment, role, probability."""
    means = rows.groupBy("segment", "role").agg(F.avg("probability").alias("p"))
    return means.groupBy("segment").agg(F.max_by("role", F.struct("p", "role")).alias("role"), F.max("p").alias("probability"), F.max(F.when(F.col("role") == "reasoning", F.col("p"))).alias("reasoning_probability"))


def neutral_pair_violations(tokens: DataFrame) -> DataFrame:
    """Tokens that differ between the roles of a document. tokens: document, idx, role, token, position."""
    return tokens.groupBy("document", "idx").agg(F.countDistinct("token", "position").alias("kinds"), F.countDistinct("role").alias("roles")).where("kinds > 1 OR roles < 2")


def threshold_candidates(rows: DataFrame) -> DataFrame:
    """Distinct scores, the midpoints of neighbours, and the numbers next to the least and the greatest."""
    scores = rows.select(F.col("score").cast("double").alias("score")).distinct()
    scores, _ = materialize(rows.sparkSession, scores, "scores")
    scores = cumulative(scores, "score", [])
    both = scores.select(F.explode(F.array_compact(F.array(F.col("score"), (F.col("score") + F.col("following")) / 2))).alias("threshold"))
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    outer = [] if ends["lo"] is None else [(math.nextafter(ends["lo"], -math.inf),), (math.nextafter(ends["hi"], math.inf),)]
    return both.unionByName(rows.sparkSession.createDataFrame(outer, "threshold double")).distinct()


def classify(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "reasoning").otherwise("final")


def coverage(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """(requested, answered, unexpected) by coordinates."""
    a, b = requests.select(*keys).distinct().withColumn("a", F.lit(1)), results.select(*keys).distinct().withColumn("b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(F.count("a").alias("requested"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("answered"), F.count_if(F.col("a").isNull()).alias("unexpected"))


def descriptive_probabilities(rows: DataFrame) -> DataFrame:
    """(pair, probability, times): probabilities of descriptive rows by pair, each value once with how often it occurs."""
    return rows.where(F.col("expectation") == "descriptive").groupBy("pair", "probability").agg(F.count(F.lit(1)).alias("times"))
