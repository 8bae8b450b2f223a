"""Bradley-Terry fits against a plain solver, components against a search, and planted orders."""

import numpy as np
import plain
import pytest

from pyspark.sql import functions as F

from pairforge.operators import graph, multinomial, ranking
from pairforge.operators.validate import InvalidData
from pairforge.shared import literal


def naive_fit(size, trials, l2):
    """Gradient descent with small steps on single trials."""
    s = np.zeros(size)
    for _ in range(60_000):
        g = l2 * s
        for a, b, y in trials:
            p = 1 / (1 + np.exp(-(s[a] - s[b])))
            g[a] += p - y
            g[b] -= p - y
        if np.abs(g).max() < 1e-11:
            break
        s = s - 0.05 * g
    return s - s.mean()


@pytest.mark.parametrize("l2", [0.1, 1.0, 10.0])
def test_newton_matches_gradient_descent(l2):
    rng = np.random.default_rng(3)
    trials = [(int(a), int(b), float(rng.choice([0, 0.5, 1]))) for a, b in rng.integers(0, 5, (30, 2)) if a != b]
    a, b, y = map(np.array, zip(*trials, strict=True))
    fit = ranking.fit_component(5, a, b, np.ones(len(a)), y.astype(float), ranking.FitConfig(l2))
    assert fit.converged
    assert np.allclose(fit.scores, naive_fit(5, trials, l2), atol=1e-7)


def observations(spark, trials):
    rows = []
    for t, (a, b, won) in enumerate(trials):
        rows += [(str(t), a, 1, won >= 0.5), (str(t), b, 2, won <= 0.5)]
    df = literal(spark, rows, "trial_id string, cell_id string, position int, completed boolean")
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in ("instruction", "framing", "channel", "author", "assistant", "pair_id", "side", "skill", "conflict")))


def test_planted_order_and_bootstrap(spark):
    rng = np.random.default_rng(0)
    true = {"a": 1.5, "b": 0.5, "c": -0.5, "d": -1.5}
    trials = []
    for _ in range(400):
        x, y = rng.choice(list(true), 2, replace=False)
        trials.append((x, y, float(rng.random() < 1 / (1 + np.exp(true[y] - true[x])))))
    trials.append(("y", "z", 1.0))
    out = {r["cell_id"]: r for r in ranking.ranking(observations(spark, trials), ranking.FitConfig(bootstrap=30, chunk=10), bootstrap=True).collect()}
    assert [out[c]["rank"] for c in "abcd"] == [1, 2, 3, 4]
    assert out["a"]["component"] == 0 and out["y"]["component"] == 1
    assert out["a"]["bootstrap_low"] <= out["a"]["score"] <= out["a"]["bootstrap_high"]
    assert out["y"]["score"] > 0 > out["z"]["score"]
    again = ranking.ranking(observations(spark, trials), ranking.FitConfig(bootstrap=30, chunk=10), bootstrap=True)
    assert {r["cell_id"]: r["bootstrap_low"] for r in again.collect()} == {c: r["bootstrap_low"] for c, r in out.items()}


def test_components_of_paths_and_isolated_nodes(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    nodes = literal(spark, [(i,) for i in [*range(41), 100, 101, 102, 500]], "node long")
    got = {r["node"]: r["label"] for r in graph.components(nodes, literal(spark, edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[500] == 500
    assert graph.components(literal(spark, [], "node long"), literal(spark, [], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def activations(spark):
    """Two layers, of which the second tells the three classes apart better; one is 4 wide, the other 6."""
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(900, 4)), rng.normal(size=(900, 6))
    y = (z[:, 0] + 0.3 * x[:, 0] + 0.5 * rng.normal(size=900) > 0).astype(int) + (z[:, 1] > 0.8)
    split = np.repeat(["train", "validation", "test"], [400, 300, 200])
    data = [(s, int(k), [a.tolist(), b.tolist()]) for s, k, a, b in zip(split, y, x, z, strict=True)]
    return split, y, (x, z), literal(spark, data, "split string, label int, features array<array<double>>").repartition(5)


@pytest.mark.parametrize("newton", [1024, 0])
def test_grid_fits_all_rows_of_every_layer(activations, newton):
    """Newton's and L-BFGS's minima are those of the plain fit on all rows; the rule chooses, the chosen one is fitted again."""
    split, y, layers, rows = activations

    def judge(w, x, part):
        score = np.hstack([x[split == part], np.ones(((split == part).sum(), 1))]) @ w.T
        log = score - np.log(np.exp(score).sum(1, keepdims=True))
        return float((score.argmax(1) == y[split == part]).mean()), float(-log[np.arange(len(log)), y[split == part]].mean())

    cfg = multinomial.ProbeGridConfig(3, (0.1, 10.0), (0, 1), newton=newton, fan_in=2, driver_bytes=1)
    probe = multinomial.train_probe(rows, cfg)
    got = {(r["layer"], r["penalty"]): r for r in probe.grid.collect()}
    want = {}
    for layer, x in enumerate(layers):
        for p in cfg.penalties:
            w, _, ok = plain.fit_softmax(x[split == "train"], y[split == "train"], 3, p)
            (mine,) = (f for f in probe.fits if (f.layer, f.penalty) == (layer, p))
            assert ok and np.abs((mine.weights - mine.weights.mean(0)) - (w - w.mean(0))).max() < 1e-5
            want[layer, p] = judge(w, x, "validation")
    best = max(want, key=lambda k: (want[k][0], -want[k][1], k[1], -k[0]))
    assert best[0] == 1
    again, _, _ = plain.fit_softmax(layers[1][split != "test"], y[split != "test"], 3, best[1])
    for key, r in got.items():
        assert (r["validation_accuracy"], r["validation_loss"]) == pytest.approx(want[key], rel=1e-5) and r["converged"] and r["selected"] == (key == best)
        assert (r["test_accuracy"], r["test_loss"]) == (pytest.approx(judge(again, layers[1], "test"), rel=1e-5) if key == best else (None, None))
    found = {(r["layer"], r["penalty"]): r["largest_gradient"] for r in multinomial.fit_conditions(rows.where("split = 'train'"), probe).collect()}
    assert set(found) == set(got) and max(found.values()) < 1e-7


def test_grid_never_chooses_what_failed(activations):
    _, _, _, rows = activations
    once = multinomial.train_probe(rows, multinomial.ProbeGridConfig(3, (1e-3, 1e3), (1,), steps=5))
    got = {r["penalty"]: r for r in once.grid.collect()}
    assert got[1e3]["converged"] and got[1e3]["selected"] and not got[1e-3]["converged"] and not got[1e-3]["selected"]
    assert got[1e-3]["validation_accuracy"] > got[1e3]["validation_accuracy"]
    with pytest.raises(InvalidData, match="no candidate"):
        multinomial.train_probe(rows, multinomial.ProbeGridConfig(3, (1e-3,), (1,), steps=1))
    with pytest.raises(InvalidData, match="classes"):
        multinomial.train_probe(rows, multinomial.ProbeGridConfig(2, (1.0,)))
    with pytest.raises(InvalidData, match="lack a layer"):
        multinomial.train_probe(rows, multinomial.ProbeGridConfig(3, (1.0,), (2,)))
    assert multinomial.probe_grid(rows.where("split <> 'train'"), multinomial.ProbeGridConfig(3, (1.0,))).count() == 0


def test_ties_go_to_the_greater_penalty_and_the_smaller_layer(activations):
    _, _, _, rows = activations
    twice = rows.withColumn("features", F.array(F.element_at("features", 2), F.element_at("features", 2)))
    grid = multinomial.probe_grid(twice, multinomial.ProbeGridConfig(3, (1.0,), (0, 1))).collect()
    assert [r["layer"] for r in grid if r["selected"]] == [0] and grid[0]["validation_loss"] == grid[1]["validation_loss"]




def test_fits_are_dealt_over_all_cores(spark):
    """Few bytes, much work: the groups of fits and bootstraps are not packed into one task; pairs are fitted once, whatever their outcomes."""
    met = literal(spark, [(k, f"{k}a", f"{k}b", x, 3) for k in range(12) for x in (0.0, 0.5, 1.0)], "component int, first string, second string, outcome double, n long")
    cfg = ranking.FitConfig(bootstrap=4, chunk=2)
    for df in (ranking.bootstrap_scores(met, cfg), ranking.fit_scores(met, [1.0], cfg)):
        plain = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(plain) >= 4
    first, second, at = ranking._pairs(4, np.array([2, 0, 2]), np.array([3, 1, 3]))
    assert first.tolist() == [0, 2] and second.tolist() == [1, 3] and at.tolist() == [1, 0, 1]
