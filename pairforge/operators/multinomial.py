"""Multinomial probes fitted on all rows: every layer and penalty in the same passes over the data.

A pass sends the parameters of all fits that still run to the tasks; each task sends back, for every fit, its rows' sums of
loss and gradient (and of second derivatives, while the model is small), and sums are added up in a tree. The
driver holds models and sums, whose sizes the model decides, never rows. Small models take Newton steps, others L-BFGS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.stats import softmax
from pairforge.operators.validate import InvalidData
from pairforge.shared import literal, materialize, ship

SUMS = "fit int, part long, sums binary"
#: Intercepts are not penalized; this keeps their common direction from drifting.
RIDGE = 1e-8
#: Least probability in a loss.
FLOOR = 1e-15
#: Entries of a gradient that one row of fit_conditions' aggregate holds.
PLACES = 32


@dataclass(frozen=True)
class ProbeGridConfig:
    classes: int
    penalties: tuple[float, ...]
    layers: tuple[int, ...] = (0,)
    #: Accepted steps of a fit; one that needs more has not converged.
    steps: int = 200
    #: Largest entry of the gradient, a row.
    tolerance: float = 1e-8
    #: Parameters up to which second derivatives are summed.
    newton: int = 1024
    #: Steps that L-BFGS remembers.
    memory: int = 12
    #: Sums that one task of the tree adds up, and bytes of sums that go to the driver in a pass.
    fan_in: int = 64
    driver_bytes: int = 64 << 20


def _matrix(batch: pa.RecordBatch, layer: int) -> np.ndarray:
    """Features of one layer with a column of ones."""
    lists = batch.column("features").flatten() if pa.types.is_list(batch.column("features").type.value_type) else None
    if lists is None:
        raise InvalidData("features must be an array of layers, each an array of numbers")
    per_row = len(lists) // batch.num_rows
    wanted = lists.take(pa.array(np.arange(batch.num_rows) * per_row + layer))
    x = wanted.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _log_probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = x @ w.T
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def _part() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        n = len(sums)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_part()] * n, pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["fit", "part", "sums"])


def _derivatives(fits: list[tuple[int, int, np.ndarray]], second: bool):
    """Sums over a task's rows for each (number, layer, weights): rows, loss, gradient, and second derivatives if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            matrices = {layer: _matrix(batch, layer) for layer in {f[1] for f in fits}}
            for number, layer, w in fits:
                x, classes = matrices[layer], len(w)
                log = _log_probabilities(x, w)
                p = np.exp(log)
                off = p.copy()
                off[np.arange(len(y)), y] -= 1.0
                out = [np.array([len(y), -log[np.arange(len(y)), y].sum()]), (off.T @ x).ravel()]
                if second:
                    d = x.shape[1]
                    h = np.empty((classes, d, classes, d))
                    for a in range(classes):
                        for b in range(a, classes):
                            h[a, :, b] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                            h[b, :, a] = h[a, :, b].T
                    out.append(h.ravel())
                out = np.concatenate(out)
                sums[number] = sums[number] + out if number in sums else out
        yield from _emit(sums)

    return run


def _scores(fits: list[tuple[int, int, np.ndarray]]):
    """Sums over a task's rows: rows, rows told right, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for number, layer, w in fits:
                log = _log_probabilities(_matrix(batch, layer), w)
                mine = np.maximum(log[np.arange(len(y)), y], np.log(FLOOR))
                out = np.array([len(y), (log.argmax(1) == y).sum(), -mine.sum()])
                sums[number] = sums[number] + out if number in sums else out
        yield from _emit(sums)

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v) for v in table.column("sums").to_pylist()], axis=0)
    return pa.table({"fit": table.column("fit").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def tree_sums(parts: DataFrame, tasks: int, rows: int, fan_in: int) -> dict[int, np.ndarray]:
    """The sum of each fit's vectors; at most `rows` of them for each go to the driver, what is more is added up in tasks before."""
    while tasks > rows:
        tasks = max(rows, -(-tasks // fan_in))
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("fit", "part").applyInArrow(_add, SUMS)
    out: dict[int, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["fit"], r["part"])):  # in one order, so that sums are the same each time
        v = np.frombuffer(r["sums"])
        out[r["fit"]] = out[r["fit"]] + v if r["fit"] in out else v
    return out


@dataclass
class ProbeFit:
    """One fit on its way down: where it is, where it tries to go, and what it remembers."""

    layer: int
    penalty: float
    weights: np.ndarray
    trial: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    move: np.ndarray | None = None
    size: float = 1.0
    steps: int = 0
    converged: bool = False
    done: bool = False
    largest_gradient: float = np.inf
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def _penalties(self) -> np.ndarray:
        out = np.full(self.weights.shape, self.penalty)
        out[:, -1] = RIDGE
        return out.ravel()

    def _direction(self, second: np.ndarray | None) -> np.ndarray:
        g = self.gradient
        if second is not None:
            return -np.linalg.solve(second.reshape(g.size, g.size) + np.diag(self._penalties()), g)
        q, kept = g.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(self.past, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def receive(self, sums: np.ndarray, cfg: ProbeGridConfig) -> None:
        """Takes the sums at the trial point: goes there if that is low enough, else tries half as far."""
        k = self.weights.size
        w, ridge = self.trial.ravel(), self._penalties()
        value, gradient = sums[1] + 0.5 * float(ridge @ (w * w)), sums[2 : 2 + k] + ridge * w
        if self.move is not None:
            slope = float(self.gradient @ self.move)
            if not value <= self.value + 1e-4 * self.size * slope + 1e-13 * abs(self.value):
                self.size /= 2
                self.done = self.size < 1e-12
                self.trial = self.weights + self.size * self.move.reshape(self.weights.shape)
                return
            s, y = self.size * self.move, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-cfg.memory :]
            self.steps += 1
        self.weights, self.value, self.gradient = self.trial, value, gradient
        self.largest_gradient = float(np.abs(gradient).max()) / max(1.0, sums[0])
        self.converged = bool(self.largest_gradient <= cfg.tolerance)
        if self.converged or self.steps >= cfg.steps or not np.isfinite(value):
            self.done = True
            return
        self.move, self.size = self._direction(sums[2 + k :] if sums.size > 2 + k else None), 1.0
        self.trial = self.weights + self.move.reshape(self.weights.shape)


def _sums(rows: DataFrame, fits: list[ProbeFit], cfg: ProbeGridConfig, kernel, size: int) -> dict[int, np.ndarray]:
    numbered = [(k, f.layer, f.trial) for k, f in enumerate(fits)]
    most = max(1, min(cfg.fan_in, cfg.driver_bytes // (8 * size * len(fits))))
    selected = rows.select("label", "features")
    return tree_sums(selected.mapInArrow(kernel(numbered), SUMS), selected.rdd.getNumPartitions(), most, cfg.fan_in)


def run_fits(rows: DataFrame, fits: list[ProbeFit], cfg: ProbeGridConfig) -> None:
    """Passes over rows (stored: label, features) until every fit has converged or given up."""
    while running := [f for f in fits if not f.done]:
        k = running[0].weights.size
        second = k <= cfg.newton
        sums = _sums(rows, running, cfg, lambda numbered: _derivatives(numbered, second), 2 + k + second * k * k)
        for number, f in enumerate(running):
            f.receive(sums[number], cfg)


def score_fits(rows: DataFrame, fits: list[ProbeFit], cfg: ProbeGridConfig) -> list[tuple[float, float]]:
    """(accuracy, mean loss) of each fit over all rows, in one pass."""
    sums = _sums(rows, fits, cfg, _scores, 3) if fits else {}
    return [(sums[k][1] / sums[k][0], sums[k][2] / sums[k][0]) if k in sums else (0.0, 0.0) for k in range(len(fits))]


def _start(layer: int, penalty: float, weights: np.ndarray) -> ProbeFit:
    return ProbeFit(layer, penalty, weights, weights)


def fit_grid(rows: DataFrame, cfg: ProbeGridConfig, width: dict[int, int]) -> list[ProbeFit]:
    """Fits of every layer and penalty: the greatest penalty from zero, the others from where that one ended."""
    order = sorted(set(cfg.penalties), reverse=True)
    first = {layer: _start(layer, order[0], np.zeros((cfg.classes, width[layer] + 1))) for layer in cfg.layers}
    run_fits(rows, list(first.values()), cfg)
    rest = [_start(layer, p, first[layer].weights) for layer in cfg.layers for p in order[1:]]
    run_fits(rows, rest, cfg)
    return sorted([*first.values(), *rest], key=lambda f: (f.layer, f.penalty))


GRID = "layer int, penalty double, validation_accuracy double, validation_loss double, test_accuracy double, test_loss double, converged boolean, steps int, largest_gradient double, selected boolean"


@dataclass
class TrainedProbe:
    """The grid's candidates, their fits, and the chosen one fitted again; none where there are no training rows."""

    grid: DataFrame
    fits: list[ProbeFit]
    chosen: ProbeFit | None


def train_probe(rows: DataFrame, cfg: ProbeGridConfig) -> TrainedProbe:
    """Fits every (layer, penalty) on all training rows, judges them on all validation rows and chooses one.

    rows: split, label int, features: an array of layers, each an array of numbers. The best candidate by (accuracy,
    smaller loss, greater penalty, smaller layer) is fitted again on training and validation rows and judged once, on all test
    rows. A candidate that did not converge is recorded but never chosen; an error, if none did or the last fit does not.
    """
    spark = rows.sparkSession
    ship(spark)
    stored, _ = materialize(spark, rows.select("split", "label", "features").repartition(spark.sparkContext.defaultParallelism), "probe-rows")
    part = lambda *names: stored.where(F.col("split").isin(*names))
    shape = part("train").select(F.transform("features", lambda v: F.size(v)).alias("sizes"), F.col("label")).groupBy("sizes").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).limit(2).collect()
    if not shape:
        return TrainedProbe(literal(spark, [], GRID), [], None)
    if len(shape) > 1 or shape[0]["lo"] < 0 or shape[0]["hi"] >= cfg.classes or max(cfg.layers) >= len(shape[0]["sizes"]):
        raise InvalidData("training rows differ in their layers, lack a layer, or have labels beyond the classes")
    fits = fit_grid(part("train"), cfg, dict(enumerate(shape[0]["sizes"])))
    judged = score_fits(part("validation"), fits, cfg)
    able = [k for k, f in enumerate(fits) if f.converged]
    if not able:
        raise InvalidData("no candidate of the grid converged")
    best = max(able, key=lambda k: (judged[k][0], -judged[k][1], fits[k].penalty, -fits[k].layer))
    chosen = _start(fits[best].layer, fits[best].penalty, fits[best].weights)
    run_fits(part("train", "validation"), [chosen], cfg)
    if not chosen.converged:
        raise InvalidData("the chosen candidate did not converge when fitted again")
    (test,) = score_fits(part("test"), [chosen], cfg)
    out: list[tuple[Any, ...]] = []
    for k, f in enumerate(fits):
        out.append((f.layer, f.penalty, float(judged[k][0]), float(judged[k][1]), *(map(float, test) if k == best else (None, None)), f.converged, f.steps, f.largest_gradient, k == best))
    return TrainedProbe(literal(spark, out, GRID), fits, chosen)


def probe_grid(rows: DataFrame, cfg: ProbeGridConfig) -> DataFrame:
    """GRID: one row per candidate; see train_probe."""
    return train_probe(rows, cfg).grid


def fit_conditions(rows: DataFrame, probe: TrainedProbe) -> DataFrame:
    """(layer, penalty, largest_gradient): the greatest entry of each fit's gradient, a row, by Spark's own functions.

    rows: label, features, those that were fitted. What a minimum is, computed without the kernels that found it.
    """
    spark = rows.sparkSession
    fits = literal(spark, [(f.layer, f.penalty, f.weights.tolist()) for f in probe.fits], "layer int, penalty double, weights array<array<double>>")
    both = rows.select("label", "features").repartition(spark.sparkContext.defaultParallelism).join(F.broadcast(fits), how="cross")
    x = F.concat(F.transform(F.element_at("features", F.col("layer") + 1), lambda v: v.cast("double")), F.array(F.lit(1.0)))
    both = both.select("layer", "penalty", "label", x.alias("x"), "weights")
    dot = lambda w: F.aggregate(F.zip_with(w, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = both.select("layer", "penalty", "label", "x", softmax(F.transform("weights", dot)).alias("p"))
    by_class = p.select("layer", "penalty", "label", "x", F.posexplode("p").alias("class", "q"))
    off = (F.col("q") - (F.col("class") == F.col("label")).cast("double")).alias("off")
    off = by_class.select("layer", "penalty", "class", off, "x", F.explode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(PLACES))).alias("start"))
    parts = [F.sum(F.col("off") * F.get("x", F.col("start") + i)).alias(f"g{i}") for i in range(PLACES)]
    sums = off.groupBy("layer", "penalty", "class", "start").agg(*parts, F.count(F.lit(1)).alias("n"))
    sums = sums.select("layer", "penalty", "class", "start", "n", F.posexplode(F.array(*(f"g{i}" for i in range(PLACES)))).alias("at", "g")).select("layer", "penalty", "class", (F.col("start") + F.col("at")).alias("place"), "g", "n")
    own = fits.select("layer", "penalty", F.posexplode("weights").alias("class", "row")).select("layer", "penalty", "class", F.size("row").alias("width"), F.posexplode("row").alias("place", "w"))
    pull = F.when(F.col("place") < F.col("width") - 1, F.col("penalty") * F.col("w")).otherwise(0.0)
    return sums.join(own, ["layer", "penalty", "class", "place"]).groupBy("layer", "penalty").agg(F.max(F.abs(F.col("g") + pull) / F.col("n")).alias("largest_gradient"))
