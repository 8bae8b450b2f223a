"""Samples: sizes, strata, connection, and independence of other pairs."""

from collections import Counter

import numpy as np
import pytest

from pairforge.operators import design, lasso, sampling
from pairforge.plans.fixture import observations, pair_bank

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    bank = pair_bank(spark, SF).where("pair_id < '3'")
    return design.ranked_edges(design.eligible_edges(design.pair_specs(bank)))


def test_sample_is_connected_stratified_and_repeatable(spark, edges):
    rows = sampling.sample_pairs(edges, 7).collect()
    assert Counter(r["pair_id"] for r in rows) == {"1-URGENT": 720, "2-HIGH": 720}
    quota = {(r["pair_id"], r["channel1"], r["channel2"], r["framing_differs"], r["author_differs"]): r["quota"] for r in design.strata_quotas(design.edge_strata(edges), design.pairing_counts(design.pair_specs(pair_bank(spark, SF).where("pair_id < '3'")))).collect()}
    got = Counter((r["pair_id"], r["channel1"], r["channel2"], r["framing1"] != r["framing2"], r["author1"] != r["author2"]) for r in rows)
    assert sum(abs(got[k] - v) for k, v in quota.items()) <= 8
    for pair in ("1-URGENT", "2-HIGH"):
        mine = [r for r in rows if r["pair_id"] == pair]
        forest, place = sampling.Forest(306), {}
        for r in mine:
            ends = [place.setdefault((s, r[f"spec_no{s}"]), len(place)) for s in (1, 2)]
            forest.join(*ends)
        assert len(place) == 306 and len({forest.root(v) for v in range(306)}) == 1
        degree = Counter(x for r in mine for x in ((1, r["spec_no1"]), (2, r["spec_no2"])))
        assert max(degree.values()) <= 12
    alone = sampling.sample_pairs(edges.where("pair_id = '2-HIGH'"), 7).collect()
    assert {(r["spec_no1"], r["spec_no2"]) for r in alone} == {(r["spec_no1"], r["spec_no2"]) for r in rows if r["pair_id"] == "2-HIGH"}


def test_bounds():
    one = [sampling.Edge(0, 1, ("u", "u", False, False), ("u", "u"))]
    assert sampling.sample_edges(one, 2, ["u", "u"], 1, 0) == [0]
    with pytest.raises(ValueError):
        sampling.sample_edges(one, 2, ["u", "u"], 2, 0)


def test_repair_connects():
    import random

    edges = [sampling.Edge(a, b, ("u", "u", False, False), ("u", "u")) for a in range(4) for b in range(4, 8)]
    taken = [k for k, e in enumerate(edges) if e.a < 2 and e.b < 6 or e.a >= 2 and e.b >= 6]
    fixed = sampling.connect(edges, 8, taken, random.Random(1))
    forest = sampling.Forest(8)
    for k in fixed:
        forest.join(edges[k].a, edges[k].b)
    assert len(fixed) == len(taken) and len({forest.root(v) for v in range(8)}) == 1
    assert len(set(fixed) ^ set(taken)) == 2


def test_lasso_is_optimal_and_screens(spark):
    import numpy as np

    rows = lasso.comparison_rows(observations(spark, SF)).where("assistant = 'F'").toPandas()
    order = lasso.AxisOrder((), (), (), (), (), ())
    p, features, fitted, blocks, _ = lasso.assemble(rows, order)
    assert {f["status"] for f in features} >= {"fitted"} and len(fitted) == p.x.shape[1]
    cfg = lasso.LassoConfig(order=order)
    for penalty in (5.0, 1.0):
        o, b, ok, _ = lasso.solve(p, np.zeros(p.blocks), np.zeros(p.x.shape[1]), 1.0, penalty, cfg)
        pull = p.y - p.n / (1 + np.exp(-p.eta(o, b)))
        g = p.x.T @ pull
        assert ok
        assert np.abs(np.bincount(p.block, p.sign * pull, p.blocks) - o).max() < 1e-6
        assert np.abs(g).max() <= penalty * (1 + 1e-6)
        assert np.allclose(g[b != 0], penalty * np.sign(b[b != 0]), atol=1e-5)


@pytest.mark.parametrize("rows", [60, 400])
def test_the_strong_rule_changes_no_path(rows):
    """More features than rows and fewer: the path with screening is the path without."""
    rng = np.random.default_rng(rows)
    x = rng.integers(-1, 2, (rows, 90)).astype(float)
    x[:, 60:] = x[:, :30] + 0.1 * rng.normal(size=(rows, 30))
    n = rng.integers(1, 4, rows).astype(float)
    y = np.round(n * (1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + 0.5 * x[:, 61]))) > rng.random(rows)), 0)
    p = lasso.Problem(x, n, y, rng.integers(0, 3, rows), rng.choice([-1.0, 1.0], rows), 3)
    cfg = lasso.LassoConfig()
    o, b, _, _ = lasso.solve(p, np.zeros(3), np.zeros(90), 1.0, np.inf, cfg)
    top = float(np.abs(p.pull(o, b)).max())
    lambdas = [top * 0.02 ** (k / 14) for k in range(15)]
    for (o1, b1, ok, _), penalty in zip(lasso.fit_path(p, 1.0, lambdas, cfg), lambdas, strict=True):
        o, b, _, _ = lasso.solve(p, o, b, 1.0, penalty, cfg)
        assert ok and np.abs(b - b1).max() < 1e-6 and np.abs(o - o1).max() < 1e-6
        g = np.abs(p.pull(o1, b1))
        assert (g <= penalty * (1 + 1e-6)).all() and np.allclose(g[b1 != 0], penalty, rtol=1e-5)


def test_lasso_tables_are_whole(spark):
    from pairforge.plans.queries import FIXTURE_ORDER

    obs = observations(spark, SF).where("assistant IN ('F', 'O')")
    t = lasso.fit_lassos(obs, lasso.LassoConfig(order=FIXTURE_ORDER, path=6, folds=2))
    path = {(r["assistant"], r["lambda_index"]): r for r in t["path"].collect()}
    assert all(r["lambda_ratio"] == pytest.approx(1e-3 ** (k / 5)) for (_, k), r in path.items())
    chosen = {r["assistant"]: r for r in t["chosen"].collect()}
    values = {(r["assistant"], r["lambda_index"], r["feature"]): r["coefficient"] for r in t["coefficients"].collect()}
    for r in t["features"].collect():
        a, f = r["assistant"], r["feature"]
        if r["status"] != "fitted":
            assert r["entry_index"] is None and r["coefficient_selected"] is None
            continue
        entry = min((k for k in range(6) if values[a, k, f] != 0), default=None)
        assert (r["entry_index"], r["coefficient_selected"], r["coefficient_cv_min"]) == (entry, values[a, chosen[a]["selected"], f], values[a, chosen[a]["index_min"], f])
        assert (r["entry_lambda"], r["entry_lambda_ratio"]) == ((None, None) if entry is None else (path[a, entry]["lambda"], pytest.approx(path[a, entry]["lambda_ratio"])))
    assert all(r["first_side_win_probability"] == pytest.approx(1 / (1 + np.exp(-r["offset_selected"]))) for r in t["blocks"].collect())
    for r in t["diagnostics"].collect():
        assert r["candidate_features"] == r["fitted_features"] + r["never_differing_features"] + r["aliased_features"] and r["design_rank"] <= min(r["fitted_features"], r["comparisons"])
        assert r["lambda_selected"] == path[r["assistant"], r["selected_index"]]["lambda"] and set(r["references"]) == {"framing", "channel", "author"} and r["folds"] == 2
    assert t["diagnostics"].count() == 2


def test_lasso_arguments():
    with pytest.raises(ValueError):
        lasso.LassoConfig(folds=1)
    with pytest.raises(ValueError):
        lasso.LassoConfig(l2=0)


def test_lasso_queries_run_the_whole_grid(monkeypatch):
    from pairforge.plans import queries

    monkeypatch.setattr(queries, "observations", lambda *_: None)
    monkeypatch.setattr(queries.lasso, "fit_lassos", lambda _, cfg: cfg)
    cfg = queries._lassos(None, "")
    assert (cfg.path, cfg.folds) == (40, 5)


def test_lasso_keeps_no_matrix_of_rows():
    """Features in factors: their sums are those of the whole matrix, and twenty times the rows hold no larger arrays than a few numbers a row."""
    import itertools

    import pandas as pd

    rng = np.random.default_rng(5)
    cells = list(itertools.product("abc", "xy", "pqrs"))

    def some(rows):
        k, m = rng.integers(0, len(cells), (2, rows))
        frame = pd.DataFrame({"pair_id": rng.choice(["1", "2"], rows), "a_position": rng.integers(1, 3, rows), "a_side": rng.choice(["first", "second"], rows), "n": rng.integers(1, 4, rows), "y": rng.random(rows)})
        for side, at in (("a", k), ("b", m)):
            frame[f"{side}_cell_id"] = [f"{side}{i}" for i in at]
            for j, axis in enumerate(("framing", "channel", "author")):
                frame[f"{side}_{axis}"] = [cells[i][j] for i in at]
        return frame

    order = lasso.AxisOrder((), (), (), (), (), ())
    p = lasso.assemble(some(300), order)[0]
    x = p.x.z[p.x.a] - p.x.z[p.x.b] + p.x.position[:, None] * p.x.u
    w, beta, at, keep = rng.random(300), rng.random(x.shape[1]), np.array([0, 3, 7]), rng.random(300) < 0.5
    assert x.shape == p.x.shape and np.allclose(p.x @ beta, x @ beta) and np.allclose(p.x.T @ w, x.T @ w)
    assert np.allclose(p.x.gram(w), x.T @ (w[:, None] * x)) and np.allclose(p.part(keep).x[:, at].gram(w[keep]), (x[keep][:, at]).T @ (w[keep, None] * x[keep][:, at]))
    assert np.allclose(p.moments(w)[1], [(w * p.sign * (p.block == k)) @ x for k in range(2)])
    values, times = p.x.distinct(p.n)
    assert np.allclose(values.T.astype(float) @ (times[:, None] * values), x.T @ (p.n[:, None] * x))
    big = lasso.assemble(some(6000), order)[0]
    assert big.x.z.shape[0] == len(cells) and sum(v.nbytes for v in (big.x.a, big.x.b, big.x.position, big.n, big.y, big.block, big.sign)) == 7 * 8 * 6000


def test_lasso_conditions_never_pair_rows_with_features(spark, monkeypatch):
    """Fits that are no minimum are told by the same amounts as from the whole matrix; what is stored are comparisons and sums of levels."""
    from pyspark.sql import functions as F

    from pairforge.plans.queries import FIXTURE_ORDER

    obs = observations(spark, SF).where("assistant = 'F'")
    cfg = lasso.LassoConfig(order=FIXTURE_ORDER, folds=0, path=3)
    tables = lasso.fit_lassos(obs, cfg)
    tables["coefficients"] = tables["coefficients"].withColumn("coefficient", F.col("coefficient") + F.when(F.col("lambda_index") == 1, 0.1).otherwise(0.0))
    stored, keep = {}, lasso.materialize
    monkeypatch.setattr(lasso, "materialize", lambda session, df, name: stored.setdefault(name, df) and keep(session, df, name))
    found = {r["lambda_index"]: r for r in lasso.conditions(obs, tables, cfg).collect()}
    assert "row" not in {c for df in stored.values() for c in df.columns} and not any({"feature", "x"} <= set(df.columns) for df in stored.values())
    assert found[0]["excess"] < 1e-6 and found[2]["excess"] < 1e-6 and found[1]["excess"] > 1e-3
    rows = lasso.comparison_rows(obs).toPandas()
    p, _, fitted, blocks, _ = lasso.assemble(rows, FIXTURE_ORDER)
    value = {r["feature"]: r["coefficient"] for r in tables["coefficients"].where("lambda_index = 1").collect()}
    offset = {r["pair"]: r["offset"] for r in tables["offsets"].where("lambda_index = 1").collect()}
    (path,) = tables["path"].where("lambda_index = 1").collect()
    b, o = np.array([value[f] for f in fitted]), np.array([offset[k] for k in blocks])
    g, penalty = p.pull(o, b), path["lambda"]
    excess = np.where(b == 0, np.abs(g) - penalty, np.abs(g + penalty * np.sign(b))).max() * path["lambda_ratio"] / penalty
    assert found[1]["excess"] == pytest.approx(excess, rel=1e-9)
    residual = p.n / (1 + np.exp(-p.eta(o, b))) - p.y
    block = np.abs(np.bincount(p.block, p.sign * residual, p.blocks) + o) / np.bincount(p.block, p.n, p.blocks)
    assert found[1]["block_gradient"] == pytest.approx(block.max(), rel=1e-9)
