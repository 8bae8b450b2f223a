"""Extension: trials, traces and judgments that arrive as one stream of events, in any order, joined to observations as they complete."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairforge.operators.observe import observations
from pairforge.shared import ship
from pairforge.sources.buckets import KeyedTable

#: kind is trial, trace or judgment; of two of one kind the one of greater seq counts; body is the row as JSON.
EVENT = "trial_id string, kind string, seq long, at timestamp, body string"
JOINED = "trial_id string, state string, version long, trial string, trace string, judgment string"

TRIAL = "permutation int, rollout int, assistant string, input1 struct<instruction:string,framing:string,channel:string,author:string>, input2 struct<instruction:string,framing:string,channel:string,author:string>"
TRACE = "trace_fingerprint string, payload string"
JUDGMENT = "trace_fingerprint string, payload string, verdicts array<boolean>"


class Held:
    """What is known of one trial: the last trial and trace, and the last judgment of each trace that may still be the current one."""

    def __init__(self, saved: str | None = None):
        self.trial, self.trace, self.judgments, self.sent, self.failed, self.waits = json.loads(saved) if saved else (None, None, {}, None, False, False)

    def saved(self) -> str:
        return json.dumps([self.trial, self.trace, self.judgments, self.sent, self.failed, self.waits])

    def take(self, kind: str, seq: int, body: str) -> None:
        new = [int(seq), body]
        if kind == "trial" and (self.trial is None or new > self.trial):
            self.trial = new
        elif kind == "trace" and (self.trace is None or new > self.trace):
            if self.trace is not None and (was := self._mark(self.trace)) != self._mark(new):
                self.judgments.pop(was, None)
            self.trace = new
        elif kind == "judgment" and new > self.judgments.get(self._mark(new), [-1, ""]):
            self.judgments[self._mark(new)] = new

    @staticmethod
    def _mark(row: list) -> str:
        return json.loads(row[1])["trace_fingerprint"]

    def complete(self) -> tuple[int, str, str, str] | None:
        """(version, trial, trace, judgment) once all are there, the judgment being of the current trace."""
        judgment = self.judgments.get(self._mark(self.trace)) if self.trace else None
        if self.trial is None or judgment is None:
            return None
        return self.trial[0] + self.trace[0] + judgment[0], self.trial[1], self.trace[1], judgment[1]


class TrialJoin(StatefulProcessor):
    """Holds a trial until its trace and that trace's judgment are there, sends it once a version, and as failed after the delay."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "saved string")

    def _held(self) -> Held:
        return Held(self.state.get()[0]) if self.state.exists() else Held()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, newest = self._held(), 0
        for frame in rows:
            for kind, seq, body, at in zip(frame["kind"], frame["seq"], frame["body"], frame["at"], strict=True):
                held.take(kind, seq, body)
                newest = max(newest, int(at.timestamp() * 1000))
        out = held.complete()
        if out is None and not held.failed and not held.waits:
            held.waits = True
            self.handle.registerTimer(newest + self.delay_ms)
        if out is not None and list(out) != held.sent:
            held.sent = list(out)
            yield pd.DataFrame([(key[0], "joined", *out)], columns=[c.split()[0] for c in JOINED.split(", ")])
        self.state.update((held.saved(),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        held.waits = False
        if held.complete() is None and not held.failed:
            held.failed = True
            yield pd.DataFrame([(key[0], "failed", 0, None, None, None)], columns=[c.split()[0] for c in JOINED.split(", ")])
        self.state.update((held.saved(),))

    def close(self) -> None:
        pass


def joined_trials(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """JOINED rows of a stream of EVENT: a trial each time it is complete in a new version, or failed if it is not complete when event
    time is `delay` beyond its first events. A failed trial that completes later is sent as joined. Judgments of a trace that has been
    replaced are dropped, and come again if that trace should. Needs the RocksDB state store."""
    ship(events.sparkSession)
    ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    return events.withWatermark("at", delay).groupBy("trial_id").transformWithStateInPandas(TrialJoin(ms), JOINED, "Append", "EventTime")


def rows_of(joined: DataFrame) -> DataFrame:
    """Observations of joined trials."""
    done = joined.where("state = 'joined'")
    parts = [done.select("trial_id", F.from_json(c, kind).alias("r")).select("trial_id", "r.*") for c, kind in (("trial", TRIAL), ("trace", TRACE), ("judgment", JUDGMENT))]
    return observations(*parts)


def keep_observations(joined: DataFrame, table: KeyedTable, checkpoint: str):
    """A stream that upserts the observations of joined trials, the last version of each, into a table keyed by trial and position."""

    def put(batch: DataFrame, _: int) -> None:
        last = batch.where("state = 'joined'").groupBy("trial_id").agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
        table.put(rows_of(last))

    return joined.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def joined_at_once(events: DataFrame) -> DataFrame:
    """JOINED rows (state joined) of all events as one table: what the stream ends with."""
    mark = F.get_json_object("body", "$.trace_fingerprint")
    last = lambda kind, *keys: events.where(F.col("kind") == kind).groupBy("trial_id", *keys).agg(F.max(F.struct("seq", "body")).alias(kind))
    traces = last("trace").withColumn("mark", F.get_json_object("trace.body", "$.trace_fingerprint"))
    both = last("trial").join(traces, "trial_id").join(last("judgment", mark.alias("mark")), ["trial_id", "mark"])
    version = F.col("trial.seq") + F.col("trace.seq") + F.col("judgment.seq")
    return both.select("trial_id", F.lit("joined").alias("state"), version.alias("version"), F.col("trial.body").alias("trial"), F.col("trace.body").alias("trace"), F.col("judgment.body").alias("judgment"))
