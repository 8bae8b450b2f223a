"""Trials joined from a stream with late, repeated and out-of-order events, against the same join at once."""

import json
import random
from datetime import datetime, timedelta

import pytest

from pairforge.shared import literal
from pairforge.sources import buckets
from pairforge.streaming import joined

START = datetime(2024, 1, 1)
COLUMNS = "trial_id string, position int, cell_id string, instruction string, framing string, channel string, author string, assistant string, permutation int, rollout int, completed boolean, trace_fingerprint string, assistant_response_id string, judge_response_id string"


def event(trial, kind, seq, minute, **body):
    return (trial, kind, seq, (START + timedelta(minutes=minute)).isoformat(sep=" "), json.dumps(body))


def trial(t, seq=1, minute=0, assistant="m"):
    side = lambda x: {"instruction": x, "framing": "normal", "channel": "user message", "author": "user"}
    return event(t, "trial", seq, minute, permutation=1, rollout=1, assistant=assistant, input1=side("x"), input2=side("y"))


def trace(t, mark, seq=1, minute=1):
    return event(t, "trace", seq, minute, trace_fingerprint=mark, payload='{"id": "r"}')


def judgment(t, mark, verdicts, seq=1, minute=2):
    return event(t, "judgment", seq, minute, trace_fingerprint=mark, payload='{"id": "j"}', verdicts=verdicts)


def events():
    rows = []
    for k in range(30):
        t = f"t{k}"
        rows += [trial(t), trace(t, f"{t}-a"), judgment(t, f"{t}-a", [True, False])]
        if k % 3 == 0:
            rows += [trace(t, f"{t}-b", 2, 3)]
        if k % 6 == 0:
            rows += [judgment(t, f"{t}-b", [False, k % 4 == 0], 1, 4), judgment(t, f"{t}-a", [True, True], 9, 5)]
        if k % 5 == 0:
            rows += [judgment(t, f"{t}-a", [False, False], 3, 6), trial(t, 2, 6, "n")]
    return rows + [trial("no-trace"), trace("no-trial", "z"), judgment("no-trial", "z", [True, True]), trial("changed"), trace("changed", "a"), trace("changed", "b", 2), judgment("changed", "a", [True, True])]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_join_at_once(spark, tmp_path, seed):
    rows = events()
    rng = random.Random(seed)
    rng.shuffle(rows)
    rows += rng.sample(rows, 20)
    source, whole = tmp_path / "events", literal(spark, rows, joined.EVENT)
    cut = len(rows) // 3
    for k in range(3):
        literal(spark, rows[k * cut : (k + 1) * cut if k < 2 else None], joined.EVENT).coalesce(1).write.mode("append").parquet(str(source))
    literal(spark, [trial("clock", minute=600)], joined.EVENT).coalesce(1).write.mode("append").parquet(str(source))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = joined.joined_trials(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        table = buckets.KeyedTable(spark, str(tmp_path / "kept"), COLUMNS, ["trial_id", "position"], buckets=4)
        query = joined.keep_observations(stream, table, str(tmp_path / "c1")).trigger(availableNow=True).start()
        query.awaitTermination()
        failed = []
        query = stream.writeStream.foreachBatch(lambda batch, _: failed.extend(r["trial_id"] for r in batch.where("state = 'failed'").collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = joined.rows_of(joined.joined_at_once(whole))
    tidy = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    current = {r["trial_id"] for r in want.collect()}
    assert {"no-trace", "no-trial", "changed", "t3"} & current == set() and len(current) > 20
    got = table.read()
    assert tidy(got.where(got["trial_id"].isin(*current))) == tidy(want)
    waiting = {r[0] for r in rows} - current
    assert sorted(failed) == sorted(set(failed)) and {"no-trace", "no-trial"} <= set(failed) <= waiting


def test_a_held_trial():
    held = joined.Held()
    for e in (judgment("t", "a", [True, True]), trace("t", "b", 2), trace("t", "a", 1)):
        held.take(e[1], e[2], e[4])
    assert held.complete() is None and json.loads(held.trace[1])["trace_fingerprint"] == "b"
    for e in (judgment("t", "b", [False, True], 4), trial("t"), judgment("t", "b", [True, True], 3)):
        held.take(e[1], e[2], e[4])
    again = joined.Held(held.saved())
    assert again.complete()[0] == 1 + 2 + 4 and json.loads(again.complete()[3])["verdicts"] == [False, True]
