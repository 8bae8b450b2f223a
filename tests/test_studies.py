"""Saved artifacts, qualification, whole analyses and fits against plain versions."""

import hashlib
import itertools
import json
import math

import numpy as np
import plain
import pytest
import yaml
from pyspark.sql import functions as F

from pairforge.functions import text
from pairforge.operators import graph, incremental, lasso, observe, probes, qualify, ranking, reports, resampling, similar, suite, validate
from pairforge.operators.validate import InvalidData
from pairforge.plans import bundle, curation, study_queries  # noqa: F401
from pairforge.plans.fixture import observations, pair_bank
from pairforge.plans.queries import QUERIES
from pairforge.shared import literal, materialize
from pairforge.sources import artifacts, files

SF = "/root/testdata/sf0.001"
STUDY = {"assistant": "a", "inputs": [{"instruction": "x", "framing": "normal", "channel": "user message", "author": "user"}, {"instruction": "y", "framing": "casual", "channel": "README.md", "author": "user"}]}


@pytest.mark.parametrize("n", [0, 1, 2, 500])
@pytest.mark.parametrize("part", [30, 1000])
def test_cumulative_equals_a_loop(spark, n, part):
    rng = np.random.default_rng(n)
    at = sorted(set(rng.integers(0, 10_000, n).tolist()))
    rows = [(x, int(v)) for x, v in zip(at, rng.integers(0, 9, len(at)), strict=True)]
    df = literal(spark, rows, "k long, v long").repartition(3)
    got = [tuple(r) for r in graph.cumulative(df, "k", ["v"], part).orderBy("k").collect()]
    assert got == [(k, v, rows[i + 1][0] if i + 1 < len(rows) else None, sum(x for _, x in rows[:i])) for i, (k, v) in enumerate(rows)]


@pytest.mark.parametrize("in_one_task", [0, 1000])
def test_components_either_way(spark, in_one_task):
    edges = literal(spark, [("b", "c"), ("c", "d"), ("f", "e"), ("d", "b"), ("g", "g")], "a string, b string")
    nodes = literal(spark, [(x,) for x in "abcdefg"], "node string")
    labels = graph.components(nodes, edges, in_one_task)
    assert {r["node"]: r["label"] for r in labels.collect()} == dict(zip("abcdefg", "abbbeeg", strict=True))
    assert {r["node"]: r["component"] for r in graph.component_index(labels).collect()} == dict(zip("abcdefg", [0, 1, 1, 1, 2, 2, 3], strict=True))


def auc(a, b):
    return np.mean([1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b])


def pairs(spark, rows):
    return literal(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "conversation int, reasoning double, final double")


def test_calibration_by_all_candidates(spark):
    rng = np.random.default_rng(3)
    for shift in (0.3, 0.0, -0.6):
        a, b = np.round(rng.random(12) + shift, 1), np.round(rng.random(12), 1)
        r = probes.threshold_calibration(probes.paired_scores(pairs(spark, zip(a, b, strict=True)))).first()
        values = sorted({*a.tolist(), *b.tolist()})
        candidates = {math.nextafter(values[0], -math.inf), math.nextafter(values[-1], math.inf), *values, *((x + y) / 2 for x, y in itertools.pairwise(values))}
        best = max((((a >= t).mean() + (b < t).mean()) / 2, min((a >= t).mean(), (b < t).mean()), t) for t in candidates if 0 < (np.concatenate([a, b]) >= t).sum() < 24)
        assert r["auc"] == pytest.approx(auc(a, b)) and r["candidate_count"] == len(candidates) and r["usable"] == (auc(a, b) > 0.5)
        assert (r["threshold"], r["balanced_accuracy"]) == (pytest.approx(best[2]), pytest.approx(best[0])) if r["usable"] else r["threshold"] is None
        found = probes.threshold_candidates(literal(spark, [(float(v),) for v in [*a, *b]], "score double"))
        assert sorted(x["threshold"] for x in found.collect()) == pytest.approx(sorted(candidates), abs=0)
    empty = probes.threshold_calibration(literal(spark, [], "score double, positive boolean")).first()
    assert empty["threshold"] is None and not empty["usable"] and probes.threshold_candidates(literal(spark, [], "score double")).count() == 0


def test_bootstrap_and_gates(spark):
    a, b = [0.8 + i / 100 for i in range(12)], [0.1 + i / 100 for i in range(11)] + [0.85]
    cfg = resampling.BootstrapConfig(replicates=2000)
    got = resampling.paired_bootstrap(pairs(spark, zip(a, b, strict=True)), cfg).first()
    _, low, high = plain.bootstrap_auc(np.array(a), np.array(b), 2000)
    assert tuple(got) == (pytest.approx(auc(a, b)), pytest.approx(low, abs=0.03), pytest.approx(high, abs=0.01), 12)
    tokens = literal(spark, [(d, y, y if (d + y) % 5 else 1 - y, 0.9) for d in range(8) for y in (0, 1)], "document int, label int, predicted int, p double")
    cal, test = pairs(spark, zip(a, b, strict=True)), pairs(spark, zip(a, b, strict=True)).withColumn("conversation", F.col("conversation") + 100)
    row = qualify.qualification(cal, test, tokens, bootstrap=cfg).first()
    assert row["segment_passed"] and row["passed"] and row["test_auc"] == pytest.approx(auc(a, b))
    assert not qualify.qualification(cal, test.select("conversation", F.col("final").alias("reasoning"), F.col("reasoning").alias("final")), tokens, bootstrap=cfg).first()["segment_passed"]
    strict = qualify.qualification(cal, test, tokens, qualify.Gates(role_accuracy=1.0), cfg).first()
    assert strict["segment_passed"] and not strict["passed"]
    with pytest.raises(InvalidData):
        qualify.qualification(cal, cal, tokens)
    said = lambda rows: qualify.content_signatures(literal(spark, rows, "document string, position int, token long"))
    contents = {"training": said([("x", 0, 5), ("x", 1, 7)]), "calibration": said([("y", 0, 7), ("y", 1, 5)]), "test": said([("z", 1, 7), ("z", 0, 5)])}
    with pytest.raises(InvalidData, match="more than one part"):
        qualify.qualification(cal, test, tokens, bootstrap=cfg, contents=contents)
    assert qualify.qualification(cal, test, tokens, bootstrap=cfg, contents=contents | {"test": said([("z", 0, 5)])}).first()["passed"]


@pytest.mark.parametrize(("part", "cells"), [(65_536, 1 << 22), (64, 1 << 12), (7, 64)])
def test_bootstrap_by_parts(spark, part, cells):
    """Many parts, ties within and over parts: the AUC is exact, every way gives the same replicates."""
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0.6, 1, 300), 1), np.round(rng.normal(0, 1, 300), 1)
    rows = pairs(spark, zip(a, b, strict=True)).repartition(3)
    got = {r["replicate"]: r["auc"] for r in resampling.auc_replicates(rows, resampling.BootstrapConfig(40, 3, part, cells)).collect()}
    assert set(got) == set(range(41)) and got[0] == pytest.approx(auc(a, b), abs=1e-12)
    key = np.array([r[0] for r in rows.select(F.xxhash64("conversation")).collect()], np.int64)
    values = {r[0]: (r[1], r[2]) for r in rows.select(F.xxhash64("conversation"), "reasoning", "final").collect()}
    x, y = (np.array([values[k][i] for k in key.tolist()]) for i in (0, 1))
    w = resampling.poisson_weights(key, 0, 41, 3, resampling.poisson_table()).astype(float)
    wins = (x[:, None] > y) + 0.5 * (x[:, None] == y)
    for r in (1, 17, 40):
        assert got[r] == pytest.approx(w[:, r] @ wins @ w[:, r] / w[:, r].sum() ** 2, abs=1e-12)


def test_bootstrap_agrees_with_resampled_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0.5, 1, 4000), rng.normal(0, 1, 4000)
    got = resampling.paired_bootstrap(pairs(spark, zip(a, b, strict=True)), resampling.BootstrapConfig(1000)).first()
    _, low, high = plain.bootstrap_auc(a, b, 1000)
    assert (got["lower_95"], got["upper_95"]) == (pytest.approx(low, abs=0.0015), pytest.approx(high, abs=0.0015)) and got["conversations"] == 4000
    odd = pairs(spark, [(0.9, 0.1), (float("nan"), 0.2)]).unionByName(literal(spark, [(5, None, 0.5)], "conversation int, reasoning double, final double"))
    assert resampling.paired_bootstrap(odd, resampling.BootstrapConfig(20)).first()["test_auc"] == 1.0
    assert tuple(resampling.paired_bootstrap(odd.where("false"), resampling.BootstrapConfig(20)).first()) == (None, None, None, 0)


def test_poisson_weights():
    w = resampling.poisson_weights(np.arange(20_000), 4, 104, 7, resampling.poisson_table()).astype(float)
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 5], w[1:, 5])[0, 1]) < 0.03
    assert (w[:, 4:40] == resampling.poisson_weights(np.arange(20_000), 8, 44, 7, resampling.poisson_table())).all()


def test_totals_of_components(spark):
    """Draws on neighbouring ranges add up in every replicate, and are binomial."""
    total, cuts = 1000, [0, 1, 7, 500, 501, 990, 1000]
    draws = np.array([resampling.drawn_within(a, b - a, total, 5, 0, 400) for a, b in itertools.pairwise(cuts)])
    assert (draws.sum(0) == total).all() and (draws >= 0).all()
    assert draws[2].mean() == pytest.approx(493, abs=3) and draws[2].var() == pytest.approx(250, rel=0.25)
    met = literal(spark, [(c, f"{c}a", f"{c}b", o, 5 + c) for c in range(9) for o in (0.0, 1.0)], "component int, first string, second string, outcome double, n long")
    rows = ranking.bootstrap_scores(met, ranking.FitConfig(bootstrap=30, chunk=7)).select("replicate", "component", "total").distinct().collect()
    sums = {}
    for r in rows:
        sums[r["replicate"]] = sums.get(r["replicate"], 0) + r["total"]
    assert sums == dict.fromkeys(range(30), sum(2 * (5 + c) for c in range(9)))


def test_content_signatures(spark):
    rows = [("a", k, t) for k, t in enumerate([3, 1, 2])] + [("b", k, t) for k, t in enumerate([3, 1, 2])] + [("c", k, t) for k, t in enumerate([1, 3, 2])] + [("d", 0, 3), ("d", 1, 1)] + [("e", 0, 3), ("e", 0, 3), ("e", 1, 1)]
    got = {r["document"]: r["signature"] for r in qualify.content_signatures(literal(spark, rows, "document string, position int, token long").repartition(4)).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 4


def test_adoption(spark, tmp_path):
    w = np.array([[-1.0, 0.0], [1.0, 0.0]])
    rows = literal(spark, [("test", 1, [[2.0]]), ("test", 0, [[-1.0]]), ("test", 0, [[1.0]]), ("train", 0, [[9.0]])], "split string, label int, features array<array<double>>")
    marks = literal(spark, [("a", "s1"), ("b", "s2")], "document string, signature string")
    grid = literal(spark, [(0, 1.0, 0.9, 0.5, True), (1, 1.0, 0.9, 0.5, True), (0, 5.0, 0.99, 0.1, False)], "layer int, penalty double, validation_accuracy double, validation_loss double, converged boolean")
    artifacts.save_probe(spark, f"{tmp_path}/probe", 0, ["final", "reasoning"], w, {"penalty": 1.0})
    saved = artifacts.load_probe(spark, f"{tmp_path}/probe")
    got = qualify.adopt_probe(saved, marks, marks, grid, rows).first()
    loss = np.mean([np.log1p(np.exp(-2 * m)) for m in (2.0, 1.0, -1.0)])
    assert tuple(got) == (0, 1.0, pytest.approx(2 / 3), pytest.approx(loss), 2)
    for other in (marks.where("document = 'a'"), marks.withColumn("signature", F.lit("s1")), marks.withColumn("document", F.concat("document", F.lit("x")))):
        with pytest.raises(InvalidData, match="not those of the saved"):
            qualify.adopt_probe(saved, marks, other, grid, rows)
    with pytest.raises(InvalidData, match="not the best"):
        qualify.adopt_probe(saved, marks, marks, grid.where("layer = 1"), rows)


def test_probe_artifacts(spark, tmp_path):
    w = np.arange(6.0).reshape(2, 3)
    mark = artifacts.save_probe(spark, f"{tmp_path}/probe", 7, ["reasoning", "final"], w, {"penalty": 0.1})
    got = artifacts.load_probe(spark, f"{tmp_path}/probe")
    assert got["layer"] == 7 and (got["weights"] == w).all() and got["fingerprint"] == mark and got["config"] == {"penalty": 0.1}
    spark.read.parquet(f"{tmp_path}/probe").withColumn("layer", F.lit(8)).write.parquet(f"{tmp_path}/changed")
    with pytest.raises(InvalidData):
        artifacts.load_probe(spark, f"{tmp_path}/changed")


def test_activation_folder_fails_closed(spark, tmp_path):
    folder = tmp_path / "acts"
    folder.mkdir()
    np.save(folder / "a.npy", np.ones((2, 2, 3), np.float32))
    lines = [json.dumps({"shard": "a.npy", "token": k, "document": "d", "role": "final", "position": k}) for k in range(2)]
    (folder / "tokens.jsonl").write_text("\n".join(lines))

    def manifest():
        files_ = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in ("a.npy", "tokens.jsonl")}
        (folder / "manifest.json").write_text(json.dumps({"files": files_}))

    manifest()
    assert [list(r["activation"]) for r in artifacts.load_activations(spark, str(folder)).collect()] == [[1.0] * 3] * 4
    (folder / "tokens.jsonl").write_text(lines[0])
    with pytest.raises(InvalidData):
        artifacts.load_activations(spark, str(folder))
    manifest()
    with pytest.raises(InvalidData):
        artifacts.load_activations(spark, str(folder))


def test_verdicts_are_decided_again(spark, tmp_path):
    rows = literal(spark, [("s", 1, 1, "reasoning", "c", 0.6), ("s", 1, 2, "nonreasoning", "d", 0.6), ("s", 2, 1, "descriptive", "c", 0.6)], "study_id string, permutation int, position int, expectation string, channel string, probability double")
    artifacts.VerdictCache(spark, f"{tmp_path}/v", 0.5).put(rows)
    got = {(r["permutation"], r["position"]): (r["complies"], r["issue"] is None) for r in artifacts.VerdictCache(spark, f"{tmp_path}/v", 0.5).read().collect()}
    assert got == {(1, 1): (True, True), (1, 2): (False, False), (2, 1): (None, True)}
    with pytest.raises(InvalidData):
        artifacts.VerdictCache(spark, f"{tmp_path}/v", 0.7).read()


def test_saved_collections_matchups_and_caches(spark, tmp_path):
    with pytest.raises(InvalidData):
        artifacts.saved_collections(spark, str(tmp_path))
    for k in range(2):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "study.yaml").write_text(yaml.safe_dump(STUDY | {"assistant": f"a{k}"}))
    got = artifacts.saved_collections(spark, str(tmp_path)).orderBy("folder").collect()
    assert [r["study"] for r in got] == [files.study_fingerprint(STUDY | {"assistant": f"a{k}"}) for k in range(2)] and got[0]["store"].endswith("s0/collection")
    (tmp_path / "collection").mkdir()
    assert [r["store"].removeprefix("file:") for r in artifacts.saved_collections(spark, str(tmp_path)).collect()] == [f"{tmp_path}/collection"] * 2
    assert artifacts.saved_collections(spark, str(tmp_path / "s1")).count() == 1
    (tmp_path / "s1" / "study.yaml").write_text(yaml.safe_dump(STUDY | {"assistant": "a0"}))
    with pytest.raises(InvalidData):
        artifacts.saved_collections(spark, str(tmp_path))
    (tmp_path / "m.yaml").write_text(yaml.safe_dump(STUDY))
    assert artifacts.load_matchups(spark, str(tmp_path / "m.yaml")).first()["input2"]["framing"] == "casual"
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(STUDY | {"inputs": [STUDY["inputs"][0]] * 2}))
    with pytest.raises(InvalidData):
        artifacts.load_matchups(spark, str(tmp_path / "bad.yaml"))
    artifacts.write_suite(spark, [STUDY], f"file://{tmp_path}/suite.yaml")
    assert files.load_studies(spark, str(tmp_path / "suite.yaml")).count() == 1
    (tmp_path / "cache.yaml").write_text(yaml.safe_dump([{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 3}]))
    assert {tuple(r) for r in artifacts.load_yaml_cache(spark, str(tmp_path / "cache.yaml"), "k string, v int", ["k"]).collect()} == {("a", 3), ("b", 2)}


def test_saved_payloads_are_of_their_trial(spark):
    expected = literal(spark, [("t", '{"x":1}'), ("u", '{"x":2}')], "trial_id string, matchup string")
    good = literal(spark, [("t", '{"matchup":{"x":1},"status":"completed"}')], "trial_id string, payload string")
    assert artifacts.decode_saved(good, expected, "status string").first()["status"] == "completed"
    for trial in ("u", "w"):
        with pytest.raises(InvalidData):
            artifacts.decode_saved(good.withColumn("trial_id", F.lit(trial)), expected, "status string")


def test_dialogues_documents_and_texts_fail_closed(spark, tmp_path):
    d = literal(spark, [("1", "cal", "Some  Text\n"), ("2", "test", "x")], "id string, split string, text string")
    p = d.select("id", "split", suite.normalized_hash(F.col("text")).alias("sha256"))
    assert p.first()["sha256"] == hashlib.sha256(b"some text").hexdigest()
    assert [r["id"] for r in suite.partitioned_dialogues(d, p, "cal").collect()] == ["1"]
    for wrong in (d.withColumn("text", F.lit("other")), d.withColumn("split", F.lit("cal")), d.where("id = '2'"), d.unionByName(literal(spark, [("3", "cal", "y")], "id string, split string, text string"))):
        with pytest.raises(InvalidData):
            suite.partitioned_dialogues(wrong, p, "cal")
    (tmp_path / "docs.jsonl").write_text('{"id": "a", "text": "b"}\n')
    assert artifacts.load_documents(spark, [str(tmp_path / "docs.jsonl")]).count() == 1
    (tmp_path / "docs.jsonl").write_text('{"id": "a", "text": " "}\n')
    with pytest.raises(InvalidData):
        artifacts.load_documents(spark, [str(tmp_path / "docs.jsonl")])
    lib = literal(spark, [("f", "a", "text"), ("f", "b", " ")], "folder string, name string, content string")
    assert artifacts.paired_texts(lib.where("name = 'a'"), lib.where("name = 'a'")).count() == 1
    with pytest.raises(InvalidData):
        artifacts.paired_texts(lib, lib)
    with pytest.raises(InvalidData):
        artifacts.paired_texts(lib.where("name = 'a'"), literal(spark, [], "folder string, name string"))
    audit = literal(spark, [(True,), (None,)], "complies boolean")
    validate.require_compliant(audit.where("complies"))
    with pytest.raises(InvalidData):
        validate.require_compliant(audit)
    with pytest.raises(InvalidData):
        suite.compare_runs(d, d.where("id = '1'"), ["id"], ["text"])


def test_neighbours_of_every_text(spark):
    rows = [(1, 1, "a b"), (2, 1, "a b c"), (3, 2, "x y"), (4, 3, ""), (5, 4, "..."), (6, 5, "b c")]
    got = {r["id"]: (r["neighbour"], round(r["similarity"], 6)) for r in similar.jaccard_neighbours(literal(spark, rows, "id int, group int, text string")).collect()}
    assert got == {1: (6, 0.333333), 2: (6, 0.666667), 3: (1, 0.0), 4: (5, 1.0), 5: (4, 1.0), 6: (2, 0.666667)}
    assert similar.jaccard_neighbours(literal(spark, rows[:2], "id int, group int, text string")).count() == 0


def test_ids_and_fingerprints(spark):
    df = literal(spark, [("Qwen3.8 2.4T", "x"), ("other", "x"), ("other", None)], "assistant string, identity string")
    h = hashlib.blake2s(b"x", digest_size=16).hexdigest()
    assert [r[0] for r in df.select(text.tool_call_id(F.col("assistant"), F.col("identity"))).collect()] == [f"chatcmpl-tool-{h[:16]}", f"call_{h[:24]}", None]
    p = literal(spark, [('{"b": [1, {"c": "é"}], "model": "m:batch"}',), ("[1]",), ("{",), (None,)], "p string")
    want = hashlib.sha256(json.dumps({"b": [1, {"c": "é"}], "model": "m"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [r[0] for r in p.select(text.response_fingerprint(F.col("p"))).collect()] == [want, None, None, None]
    assert len({r["call_id"] for r in QUERIES["tool_call_ids"](spark, SF).collect()}) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_analysis_writes_every_table(spark, tmp_path):
    obs = observations(spark, SF).where("pair_id < '3'")
    cfg = bundle.AnalysisConfig(ranking.FitConfig(bootstrap=4), True, lasso.LassoConfig(path=4, folds=2))
    out = bundle.analyse(obs, pair_bank(spark, SF), cfg)
    names = bundle.write_analysis(out, f"file://{tmp_path}/out")
    assert len(out.tables) == 14 and set(names) == set(out.tables)
    row = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/diagnostics.json").collect()))
    assert spark.read.json(f"{tmp_path}/out/lasso_diagnostics.json").count() == obs.select("assistant").distinct().count()
    assert row["observations"] == obs.count() and row["fit_converged"] and row["trials"] == row["comparison_count"]
    said = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/report.md").collect())
    assert "## cell_ranking" in said and "## lasso_features" in said
    ranked, scores = out.tables["cell_ranking"], out.tables["axis_summary"]
    mean = {}
    for r in ranked.collect():
        assert r["bootstrap_low"] <= r["bootstrap_high"]
        for axis in ("framing", "channel", "author"):
            mean.setdefault((axis, r[axis]), []).append(r["score"])
    assert {(r["axis"], r["value"]): pytest.approx(r["mean_bt_score"]) for r in scores.collect()} == {k: pytest.approx(np.mean(v)) for k, v in mean.items()}


def test_rank_stability_equals_numpy(spark):
    fits = ranking.fit_all(observations(spark, SF).where("pair_id < '2'"))
    table = fits.fitted.toPandas().pivot(index="cell_id", columns="l2", values="rank_in")
    for r in ranking.rank_stability(fits.fitted, fits.l2).collect():
        assert r["rank_correlation_with_primary"] == pytest.approx(np.corrcoef(table[1.0], table[r["l2"]])[0, 1])
        assert r["max_absolute_rank_shift"] == int((table[1.0] - table[r["l2"]]).abs().max())


@pytest.mark.parametrize("levels", [similar.LEVELS, (), (0.5,)])
def test_nearest_texts_by_prefixes(spark, levels):
    """Random bags of words, one of which all texts have: the same as comparing all; ties by the given order."""
    rng = np.random.default_rng(5)
    words = [f"w{int(k)}" for k in np.minimum(60, rng.zipf(1.4, 4000))]
    rows, at = [], 0
    for i in range(120):
        n = int(rng.integers(0, 14))
        rows.append((i, int(rng.integers(0, 50)), int(rng.permutation(200)[0]), " ".join([*words[at : at + n], "all"]) if i % 17 else None))
        at += n
    rows += [(200 + k, k, k, "one two three four") for k in range(3)]
    df = literal(spark, rows, "id int, group int, place int, text string").repartition(3)
    bags = {i: set((t or "").split()) for i, _, _, t in rows}
    got = {r["id"]: (r["neighbour"], r["similarity"]) for r in similar.jaccard_neighbours(df, order="place", levels=levels).collect()}
    for i, g, _, _ in rows:
        others = [(j, p) for j, h, p, _ in rows if h != g]
        sim = lambda j: 1.0 if not bags[i] | bags[j] else len(bags[i] & bags[j]) / len(bags[i] | bags[j])  # noqa: E731, B023
        best = max(sim(j) for j, _ in others)
        first = min((p, j) for j, p in others if abs(sim(j) - best) < 1e-12)
        assert got[i] == (first[1], pytest.approx(best))


def test_a_word_that_all_texts_have_pairs_none(spark):
    rows = [(k, k, f"all t{k // 2}a t{k // 2}b t{k // 2}c u{k}") for k in range(400)]
    df = literal(spark, rows, "id int, group int, text string")
    bags, _ = materialize(spark, df.select("id", "group", F.col("id").alias("order"), text.word_set(F.col("text")).alias("w")), "bags")
    words = similar._ordered_words(bags)
    assert similar.candidates(bags.select("id", F.lit(0.0).alias("bound")), words, bags, F.lit(0.6)).count() == 400
    assert similar.candidates(bags.select("id", F.lit(4 / 6).alias("bound")), words, bags, F.col("bound")).count() == 400
    assert {(r["id"], r["neighbour"]) for r in similar.jaccard_neighbours(df).collect()} == {(k, k ^ 1) for k in range(400)}


def test_reports_follow_their_observations(spark, tmp_path):
    """After batches with replaced, repeated and moved trials every report is that of all observations."""
    obs = observations(spark, SF).where("pair_id < '4'")
    followed = incremental.IncrementalReports(spark, f"{tmp_path}/reports", buckets=4)
    assert all(df.count() == 0 for df in followed.reports().values())
    wrong = obs.where("trial_id % 2 = 0").withColumn("completed", F.lit(True)).withColumn("skill", F.lit("other"))
    for batch in (wrong, obs.where("trial_id % 2 = 1"), obs.where("trial_id % 2 = 0"), obs.where("trial_id % 5 = 0"), obs.where("false")):
        followed.add(batch)
    axis = reports.axis_summary(obs)
    want = {
        "axis_summary": axis, "axis_comparisons": reports.axis_comparisons(axis), "stratum_summary": reports.stratum_summary(obs), "pair_exclusivity": reports.pair_exclusivity(obs), "position_summary": reports.position_summary(obs),
        "cell_position_effects": reports.cell_position_effects(obs), "axis_position_effects": reports.axis_position_effects(obs), "order_sensitivity": reports.order_sensitivity(obs), "position_balance": reports.position_balance(obs),
    }
    got = followed.reports()
    assert set(got) == set(want)
    for name, df in want.items():
        tidy = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.select(*df.columns).collect())  # noqa: E731, B023
        assert tidy(got[name]) == tidy(df), name


def test_curation_and_its_report(spark):
    rows = [("a-1", "python", "format", "write the sum as json", "write the sum as yaml", "r"), ("b-2", "python", "format", "write the sum as json now", "use the web search tool", "r"), ("c-3", "bash", "content", "list files | sort", "never list anything", "r")]
    kinds = "pair_id string, skill string, conflict string, first string, second string, rationale string"
    bank = literal(spark, rows, kinds)
    judged = [(*rows[0], True, 3, True, 3, True, True, None), (*rows[1], True, 5, True, 3, True, False, ["odd"]), (*rows[2][:5], "another", True, 3, True, 3, True, True, None)]
    checks = literal(spark, judged, f"{kinds}, first_feasible boolean, first_difficulty int, second_feasible boolean, second_difficulty int, requires_tools boolean, mutually_exclusive boolean, issues array<string>")
    found = curation.curate(bank, checks, 0.6)
    assert {r["pair_id"]: (r["verdict"], r["difficulty"], r["reasons"]) for r in found.audit.collect()} == {"a-1": ("pass", "3 / 3", ""), "b-2": ("FAIL", "5 / 3", "first instruction difficulty 5; instructions are not mutually exclusive; odd"), "c-3": ("not audited", "", "")}
    near = {(r["pair_id"], r["slot"]): (r["nearest_pair_id"], round(r["similarity"], 6), r["over"]) for r in found.overlaps.collect()}
    assert near["a-1", "first"] == ("b-2", round(5 / 6, 6), True) and near["c-3", "first"][1] == 0.0 and len(near) == 6
    assert found.summary.first().asDict() == {"pairs": 3, "audited_pairs": 2, "failing_pairs": 1, "cache_hits": 2, "overlapping_instructions": 2, "threshold": 0.6} and not found.passed
    said = curation.curation_report(found)
    assert "list files | sort" in said and "| b-2 | python | format | FAIL |" in said and "- failing pairs: 1" in said
    assert curation.curate(bank.where("pair_id = 'a-1'"), checks, 0.6).passed
    with pytest.raises(InvalidData):
        curation.curate(bank, checks, 1.5)


def test_tasks_do_not_grow_with_requests_and_messages(spark, monkeypatch):
    """Coordinates and specifications are dealt by how many there are: with a limit of 50 rows, 1,000 make 20 parts, which adaptive execution keeps."""
    from pairforge import shared
    from pairforge.operators import requests

    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("study_id"), F.lit(1).alias("permutation"), F.lit(1).alias("position"), F.lit("a").alias("assistant"), F.lit("s").alias("spec"))
    scores = rows.select("study_id", "permutation", "position", F.col("study_id").alias("context_fingerprint"), F.lit(True).alias("complies"), F.lit(0).alias("masked"))
    issues = rows.limit(0).select("study_id", "permutation", "position", F.lit("error").alias("kind"), F.lit("r").alias("reason"))
    assert requests.request_violations(rows, scores, issues).count() == 0
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(requests.request_outcomes(rows, scores, issues)) == 20
    messages = spark.range(1000).select(F.col("id").cast("string").alias("instruction"), F.lit("f").alias("framing"), F.lit("c").alias("channel"), F.lit("a").alias("author"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("content"))
    audited, left, conflicts = observe.audit_split(messages, messages.where("content = 'x'"))
    assert (audited.count(), left.count(), conflicts.count()) == (500, 500, 0) and parts(audited) == 20
