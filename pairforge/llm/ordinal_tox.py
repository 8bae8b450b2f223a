"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade >= j) = sigmoid(w . x - threshold_j): one weight per word, shared by all thresholds, which
are kept in order. The severity of a text is its expected grade, the sum of those probabilities.
Features are which of a bounded vocabulary's words and word beginnings a text has, anywhere in it; the
vocabulary holds those that are more frequent in toxic documents by several standard errors and found in
few others, so ordinary words of long texts add nothing. Weights are not negative: no amount of harmless text makes up for a
toxic word.

The model is fitted on a bounded sample of labelled rows (`sample` ids of smallest hash, exact
copies once, and of ids with many texts the `sample` texts of smallest hash); everything else covers all rows. Labels say toxic or not; toxic sample rows whose evidence
under a first fit of that one threshold is above the median of toxic rows get the higher of two toxic
grades, so that there are ordered thresholds to share weights across. A table with graded labels can pass them as
they are.

Defined results: null text counts as empty; null grades and ids are no labels; an id labelled more
than once takes its highest grade; without labels, or with one grade only, every text has severity
0 (or that grade's) and the verdict follows from it; repeated rows are each answered; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class ToxicityConfig:
    sample: int = 8192
    vocabulary: int = 4096
    least_documents: int = 4
    least_z: float = 3.0
    least_share: float = 0.6
    l2: float = 1e-6
    steps: int = 600
    rate: float = 0.1
    cut: float = 0.5
    split_toxic: bool = True


WORD = re.compile(r"\w+")


PREFIXES = (3, 4, 5, 6)


def words_of(text: str) -> set[str]:
    """The features of a text: its words and their beginnings, the latter marked by a hyphen.

    Beginnings find words that are inflected or joined with others. One that several words of the text
    share, at least two or four, is a feature of its own, since a single such word may be chance.
    """
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        for p, count in Counter([w[:n] for w in words if len(w) > n]).items():
            out.add(p + "-")
            if count > 1:
                out.add(p + "-2")
                if count > 3:
                    out.add(p + "-4")
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """weights by word; thresholds ascending, one for each grade above the lowest."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def probabilities(self, text: str) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        score = sum(self.weights[w] for w in sorted(words_of(text) & self.weights.keys()))
        return _sigmoid(score - np.array(self.thresholds))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, e) / (1.0 + e)


def loss_and_gradient(w: np.ndarray, theta: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the cumulative-logit model with an L2 penalty on w."""
    n = grade.size
    score = np.bincount(rows, weights=w[cols], minlength=n)
    edge = np.concatenate(([-np.inf], theta, [np.inf]))
    low, high = edge[grade] - score, edge[grade + 1] - score
    a, b = _sigmoid(np.clip(low, -500, 500)), _sigmoid(np.clip(high, -500, 500))
    a, b = np.where(np.isinf(low), 0.0, a), np.where(np.isinf(high), 1.0, b)
    p = np.maximum(b - a, 1e-12)
    da, db = a * (1 - a) / p, b * (1 - b) / p
    per_row = (db - da) / n
    grad_w = np.bincount(cols, weights=per_row[rows], minlength=w.size) + l2 * w
    grad_theta = np.zeros(theta.size + 2)
    np.add.at(grad_theta, grade + 1, -db / n)
    np.add.at(grad_theta, grade, da / n)
    return float(-np.log(p).mean() + 0.5 * l2 * (w @ w)), grad_w, grad_theta[1:-1]


def fit_ordinal(features: list[np.ndarray], grade: np.ndarray, size: int, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on (w, first threshold, log gaps)."""
    rows = np.repeat(np.arange(len(features)), [f.size for f in features])
    cols = np.concatenate([*features, np.empty(0, np.int64)]).astype(np.int64)
    top = int(grade.max())
    share = np.array([(grade >= j).mean() for j in range(1, top + 1)])
    theta = -np.log(np.maximum(share, 1e-6) / np.maximum(1 - share, 1e-6))
    free = np.concatenate((np.zeros(size), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))))
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, cfg.steps + 1):
        gaps = np.exp(free[size + 1 :])
        theta = free[size] + np.concatenate(([0.0], np.cumsum(gaps)))
        _, gw, gt = loss_and_gradient(free[:size], theta, rows, cols, grade, cfg.l2)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate((gw, tail[:1], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        free[:size] = np.maximum(free[:size], 0.0)
    gaps = np.exp(free[size + 1 :])
    return free[:size], free[size] + np.concatenate(([0.0], np.cumsum(gaps)))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.worker_turn("toxicity")
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [sorted(words_of(t.as_py())) for t in part.column("text")]
            yield pa.record_batch([part.column("h"), part.column("id"), part.column("grade"), pa.array(found, pa.list_(pa.string()))], names=["h", "id", "grade", "words"])


def fit_toxicity(df: DataFrame, labels: DataFrame, cfg: ToxicityConfig, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """labels: (id, grade). The fit, on the driver, sees at most cfg.sample labelled ids and as many different texts."""
    spark = df.sparkSession
    common.ship(spark)
    graded = labels.where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").cast("int").alias("grade"))
    sample = graded.orderBy(F.xxhash64("id"), "id").limit(cfg.sample)
    texts = df.select(F.col(id_col).alias("id"), common.whole_text(text_col).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"), F.max("grade").alias("grade"), F.first("text").alias("text"))
    words, path = common.materialize(spark, texts.select("h", "id", "grade", "text").mapInArrow(_word_rows, "h long, id long, grade int, words array<string>"), "tox-sample")
    if words.count() > cfg.sample:
        words = words.where(F.col("h") <= words.select("h").orderBy("h").limit(cfg.sample).agg(F.max("h")).first()[0])
    total = words.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("k"), F.max("grade").alias("top")).first()
    if not total["n"] or not total["k"] or total["k"] == total["n"] and total["top"] == 0:
        common.remove(spark, path)
        return OrdinalModel()
    rate = min(total["k"] / total["n"], 1 - 1e-9)
    by_word = words.select(F.explode("words").alias("word"), (F.col("grade") > 0).cast("long").alias("y")).groupBy("word").agg(F.count("*").alias("d"), F.sum("y").alias("k"))
    z = (F.col("k") - F.col("d") * rate) / F.sqrt(F.col("d") * rate * (1 - rate))
    telling = by_word.where(F.col("d") >= cfg.least_documents).withColumn("z", z).where((F.col("z") >= cfg.least_z) & (F.col("k") >= cfg.least_share * F.col("d"))).orderBy(F.desc("z"), "word").limit(cfg.vocabulary)
    vocabulary = sorted(r["word"] for r in telling.select("word").collect())
    place = {w: i for i, w in enumerate(vocabulary)}
    kept = words.select("grade", F.array_intersect("words", F.lit(vocabulary) if vocabulary else F.array().cast("array<string>")).alias("words"), "id").orderBy("id").collect()
    common.remove(spark, path)
    features = [np.array(sorted(place[w] for w in r["words"]), np.int64) for r in kept]
    grade = np.array([r["grade"] for r in kept])
    if grade.max() == 1 and cfg.split_toxic and (grade == 0).any():
        w, _ = fit_ordinal(features, grade, len(vocabulary), cfg)
        share = np.array([w[f].sum() for f in features])
        middle = np.median(share[grade == 1])
        grade = grade + ((grade == 1) & (share > middle))
    w, theta = fit_ordinal(features, grade, len(vocabulary), cfg)
    return OrdinalModel({word: float(x) for word, x in zip(vocabulary, w, strict=True) if x}, tuple(theta.tolist()))


OUT = "id long, severity double, grade int, toxic boolean"


def _score_kernel(model: OrdinalModel, cfg: ToxicityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("toxicity")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                p = [model.probabilities(t.as_py()) for t in part.column(1)]
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array([float(x.sum()) for x in p], pa.float64()), pa.array([int((x >= cfg.cut).sum()) for x in p], pa.int32()), pa.array([bool(x.size and x[0] >= cfg.cut) for x in p], pa.bool_())], names=["id", "severity", "grade", "toxic"])

    return run


def toxicity(df: DataFrame, model: OrdinalModel, cfg: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected severity, most likely grade reached, and the verdict of every row."""
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return rows.mapInArrow(_score_kernel(model, cfg or ToxicityConfig()), OUT).withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: OrdinalModel, cfg: ToxicityConfig | None = None, text_col: str = "text") -> DataFrame:
    """The rows of df that are not toxic, unchanged."""
    common.ship(df.sparkSession)
    cfg = cfg or ToxicityConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("toxicity")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            p = [model.probabilities(t.as_py() or "") for t in texts]
            yield batch.filter(pa.array([not (x.size and x[0] >= cfg.cut) for x in p], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def toxic_labels(spark, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs, cfg = common.table(spark, sf_dir, "documents"), ToxicityConfig()
    return toxicity(docs, fit_toxicity(docs, toxic_labels(spark, sf_dir), cfg), cfg)
