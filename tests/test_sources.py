"""Strict readers, keyed tables, streams, and the build of observations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import text
from pairforge.operators import checks, observe, probes
from pairforge.operators.validate import InvalidData
from pairforge.plans.queries import observation_rows
from pairforge.shared import literal
from pairforge.sources import buckets, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('obs')}/rows"
    files.write_jsonl(observation_rows(spark, SF).limit(40), path)
    return path


def test_round_trip(spark, rows):
    assert files.load_observations(spark, [rows]).count() == 40


@pytest.mark.parametrize("change", [{"extra": 1}, {"completed": "yes"}, {"position": True}, {"cell_id": "0" * 16}, {"author": None}, {"rollout": 0}])
def test_broken_rows_are_rejected(spark, rows, tmp_path, change):
    row = json.loads(spark.read.text(rows).first()["value"]) | change
    (tmp_path / "bad.jsonl").write_text("\n" + json.dumps(row) + "\n")
    with pytest.raises(InvalidData):
        files.load_observations(spark, [str(tmp_path / "bad.jsonl")])


def test_empty_file_is_rejected(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n\n")
    with pytest.raises(InvalidData):
        files.load_observations(spark, [str(tmp_path / "none.jsonl")])


def test_keyed_table_replaces_by_key(spark, tmp_path):
    table = buckets.KeyedTable(spark, str(tmp_path / "t"), "trial_id string, payload string", ["trial_id"])
    assert table.read().count() == 0
    table.put(literal(spark, [("a", "1"), ("b", "1")], table.schema))
    table.put(literal(spark, [("b", "2"), ("c", "2")], table.schema))
    assert sorted(map(tuple, table.read().collect())) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_stream_upsert_is_idempotent(spark, rows, tmp_path):
    from pairforge.schema import OBSERVATION
    from pairforge.streaming import observations as streaming

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBSERVATION)
    table = buckets.KeyedTable(spark, str(tmp_path / "t"), schema, ["trial_id", "cell_id"])
    for run in range(2):
        q = streaming.upsert_stream(streaming.read_stream(spark, rows), table, str(tmp_path / f"c{run}"))
        q.processAllAvailable()
        q.stop()
    assert table.read().count() == 40


def test_pairs_yaml(spark, tmp_path):
    pair = {"id": "a-b", "skill": "s", "conflict": "c", "first": "x", "second": "y", "rationale": "r"}
    (tmp_path / "p.yaml").write_text(json.dumps({"pairs": [pair]}))
    assert files.load_pairs(spark, str(tmp_path / "p.yaml")).count() == 1
    (tmp_path / "q.yaml").write_text(json.dumps({"pairs": [pair, pair]}))
    with pytest.raises(InvalidData):
        files.load_pairs(spark, str(tmp_path / "q.yaml"))


def test_csv_of_nothing_writes_nothing(spark, tmp_path):
    assert not files.write_csv(literal(spark, [], "a int"), str(tmp_path / "x"))
    assert files.write_csv(literal(spark, [(1,)], "a int"), str(tmp_path / "y"))
    assert files.markdown(literal(spark, [(1, None)], "a int, b string")).endswith("| 1 | NA |")


def test_mismatched_judgment_fails(spark):
    spec = "struct<instruction:string,framing:string,channel:string,author:string>"
    s = {"instruction": "i", "framing": "f", "channel": "c", "author": "a"}
    trials = literal(spark, [("t", 1, 1, "m", s, s)], f"trial_id string, permutation int, rollout int, assistant string, input1 {spec}, input2 {spec}")
    traces = literal(spark, [("t", "f1", "{}")], "trial_id string, trace_fingerprint string, payload string")
    judged = literal(spark, [("t", "f2", "{}", [True, False])], "trial_id string, trace_fingerprint string, payload string, verdicts array<boolean>")
    with pytest.raises(InvalidData):
        observe.observations(trials, traces, judged)


def test_text_functions(spark):
    row = literal(spark, [('{"id": 5}', '{"id": "x"}', '{"complies": true}', '{"complies": 1}', '{"complies": true, "b": 1}')], "a string, b string, c string, d string, e string")
    out = row.select(text.response_id(F.col("a")), text.response_id(F.col("b")), text.strict_boolean(F.col("c"), "complies"), text.strict_boolean(F.col("d"), "complies"), text.strict_boolean(F.col("e"), "complies")).first()
    assert tuple(out) == (None, "x", True, None, None)
    assert row.select(text.tool_call_id(F.lit("n"), F.lit("{}")).alias("x")).first()["x"].startswith("call_")


def test_split_counts():
    shares = (0.8, 0.1, 0.1)
    assert [probes.split_counts(n, shares) for n in (0, 2, 3, 4, 10, 15)] == [[0, 0, 0], [2, 0, 0], [1, 1, 1], [2, 1, 1], [8, 1, 1], [12, 2, 1]]
    assert all(sum(probes.split_counts(n, shares)) == n for n in range(200))


def test_keyed_tables_by_buckets(spark, tmp_path):
    """Repeated keys in a batch, touched buckets alone, null keys, removal of what no version names."""
    path, kind = f"{tmp_path}/t", "a int, b string, v string"
    keyed = buckets.KeyedTable(spark, path, kind, ["a", "b"], buckets=8)
    put = lambda rows, **more: keyed.put(literal(spark, rows, f"{kind}, at int"), **more)
    put([(k, "x", "old", 0) for k in range(100)] + [(None, None, "n", 0)])
    put([(1, "x", "z-first", 1), (1, "x", "a-second", 2), (None, None, "m", 1)], order="at")
    put([(2, "x", "b", 0), (2, "x", "c", 0)])
    got = {(r["a"], r["b"]): r["v"] for r in keyed.read().collect()}
    assert len(got) == keyed.read().count() == 101 and (got[1, "x"], got[2, "x"], got[3, "x"], got[None, None]) == ("a-second", "c", "old", "m")
    put([])
    assert keyed.versions() == [2, 3]
    folders = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    held = {w: sorted(int(p.name[7:]) for p in (tmp_path / "t" / "data" / w).iterdir() if p.name.startswith("bucket=")) for w in folders}
    assert len(folders) == 3 and sorted(map(len, held.values()))[:2] in ([1, 1], [1, 2])
    put([(k, "x", "new", 0) for k in range(100)] + [(None, None, "new", 0)])
    put([(7, "x", "newer", 0)])
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and {r["v"] for r in keyed.read().collect()} == {"new", "newer"}
    with pytest.raises(InvalidData):
        buckets.KeyedTable(spark, path, "bucket int, v string", ["bucket"])


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    kind = "a int, v string"
    one, two = (buckets.KeyedTable(spark, f"{tmp_path}/t", kind, ["a"], buckets=4) for _ in range(2))
    one.put(literal(spark, [(1, "a"), (2, "a")], kind))
    before = one._current()
    two.put(literal(spark, [(1, "two")], kind))
    monkeypatch.setattr(one, "_current", lambda: before)
    with pytest.raises(buckets.Superseded):
        one.put(literal(spark, [(2, "one")], kind))
    assert {tuple(r) for r in two.read().collect()} == {(1, "two"), (2, "a")} and two.versions() == [1, 2]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and not list((tmp_path / "t" / "versions").glob("*.draft"))


def test_scoring_keeps_columns_and_parts_are_counted(spark):
    rows = [(("a", "b", None)[k % 3], k, k, f"p{k}") for k in range(60)]
    requests = literal(spark, rows, "assistant string, chunk int, _chunk int, parts string")
    sizes = []

    def scorer(frame):
        assert len(frame) <= 20
        return frame.assign(score=frame["chunk"] * 2.0)

    got = observe.score_requests(requests, scorer, "assistant string, chunk int, _chunk int, parts string, score double, error string", part=5).collect()
    assert sorted((r["chunk"], r["_chunk"], r["parts"], r["score"], r["error"]) for r in got) == sorted((k, k, f"p{k}", 2.0 * k, None) for k in range(60)) and not sizes


def test_rules_are_checked_in_the_write(spark):
    rows = literal(spark, [(1, 5), (2, None), (3, -1), (4, -2)], "id int, v int")
    rules = [checks.Rule("negative", F.col("v") < 0), checks.Rule("odd ids", F.col("id") % 2 == 1)]
    assert sorted(tuple(r) for r in checks.violations(rows, rules, "id").collect()) == [("negative", 3), ("negative", 4), ("odd ids", 1), ("odd ids", 3)]
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked-rules", "rules")
    good = checks.checked(rows.where("id = 2"), rules, "good", ("id",), least=1)
    jobs += tracker.getJobIdsForGroup("checked-rules")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in good.collect()] == [(2, None)] and len(jobs) <= 2
    with pytest.raises(InvalidData, match=r'negative: 2, such as \{"id":3\}; odd ids: 2, such as \{"id":1\}'):
        checks.checked(rows, rules, "bad", ("id",))
    with pytest.raises(InvalidData, match="0 rows"):
        checks.checked(rows.where("false"), rules, "none", ("id",), least=1)


def test_an_analysis_checks_its_trials(spark):
    from pairforge.operators import ranking

    good = [(1, "a", 1, True), (1, "b", 2, False)]
    for extra, said in (([(2, "a", 1, True)], "not two rows"), ([(2, "a", 1, True), (2, "b", 1, False)], "positions are not"), ([(2, "a", 1, True), (2, "a", 2, False)], "one cell twice")):
        with pytest.raises(InvalidData, match=said):
            ranking.checked_comparisons(literal(spark, good + extra, "trial_id int, cell_id string, position int, completed boolean"))
    assert [tuple(r) for r in ranking.checked_comparisons(literal(spark, good, "trial_id int, cell_id string, position int, completed boolean")).collect()] == [(1, "a", "b", 1.0)]


def test_softmax_computes_sums_once(spark):
    """400 entries a row: were the maximum and the total computed within the lambdas, this would take 64 million steps a row."""
    import time

    from pairforge.functions.stats import softmax

    scores = np.random.default_rng(0).normal(size=(20, 400))
    rows = spark.createDataFrame([(k, [float(v) for v in s]) for k, s in enumerate(scores)], "k int, s array<double>")
    began = time.time()
    got = np.array([r[0] for r in rows.select("k", softmax(F.col("s")).alias("p")).orderBy("k").select("p").collect()])
    assert time.time() - began < 20
    e = np.exp(scores - scores.max(1, keepdims=True))
    assert np.allclose(got, e / e.sum(1, keepdims=True), rtol=1e-12, atol=0)


def test_hash_split_sizes(spark):
    """32 documents: by largest remainders 26, 3 and 3; rounded down, as the query's SQL says, 25, 3 and 4."""
    from pairforge.plans import queries

    assert probes.floor_counts(32, (0.8, 0.1, 0.1)) == [25, 3, 4] and probes.floor_counts(10, (0.8, 0.1, 0.1)) == [8, 1, 1]
    docs = spark.range(32).withColumnRenamed("id", "doc_id")
    sizes = lambda df: {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes(probes.hash_split(docs, "doc_id", 0)) == {"train": 26, "validation": 3, "test": 3}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "table", lambda *_: docs)
        assert sizes(queries.hash_split(spark, "")) == {"train": 25, "validation": 3, "test": 4}


def test_fixed_prints_exact_values(spark):
    """Halves that are exact in binary go to the even digit, near halves by their exact value; Python prints the same."""
    rng = np.random.default_rng(1)
    values = [137 / 512, 1 / 512, 3 / 512, -137 / 512, 0.0, -0.0, 1.0, 0.999999995, 0.999999994999, 123456785e-9, 5e-9, 1.5e-8, 1e-300, 7.0, 1e14 + 0.25, *rng.random(500), *(rng.integers(0, 10**9, 500) / 1e9), *(k / (k + 1500.0) for k in range(1, 3000))]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = rows.select("v", text.fixed(F.col("v")).alias("t"), text.fixed(F.col("v"), 3).alias("u")).collect()
    assert [(r["t"], r["u"]) for r in got] == [(f"{r['v']:.8f}", f"{r['v']:.3f}") for r in got]
    odd = literal(spark, [(None,)], "v double").unionByName(spark.sql("SELECT double('NaN') AS v UNION ALL SELECT 1e22 AS v"))
    assert {r[0] for r in odd.select(text.fixed(F.col("v"))).collect()} == {None, "NaN", "10000000000000000000000.00000000"}
