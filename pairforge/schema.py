"""Relations, axes with their declared order, and the rules that rows must keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairforge.shared import literal

# Default levels of each axis in declared order. Other names of levels are parameters (AxisOrder).
FRAMINGS = ("normal", "casual", "persuasive", "subagent", "reasoning-normal", "reasoning-persuasive", "compressed-normal", "compressed-persuasive")
REASONING_FRAMINGS = FRAMINGS[4:6]
DESCRIPTIVE_FRAMINGS = FRAMINGS[6:8]
MANUAL_FRAMINGS = ("normal", "casual", "persuasive")
CHANNELS = ("system prompt", "user message", "README.md")
USER_CHANNEL = "user message"
AUTHORS = ("user", "Qwen3.8 Flash", "Qwen3.8 2.4T", "Inkling", "Inkling Small", "Gemma 4 31B", "Nemotron 3.5 Lightning")
SIDES = ("first", "second")
TERMINAL_STATUSES = ("completed",)

AXES = ("framing", "channel", "author")
STRATA = ("assistant", "skill", "conflict", "pair")

OBSERVATION = T.StructType(
    [
        T.StructField("trial_id", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("framing", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("assistant", T.StringType()),
        T.StructField("permutation", T.IntegerType()),
        T.StructField("rollout", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("completed", T.BooleanType()),
        T.StructField("trace_fingerprint", T.StringType()),
        T.StructField("assistant_response_id", T.StringType()),
        T.StructField("judge_response_id", T.StringType()),
    ]
)
OPTIONAL = ("assistant_response_id", "judge_response_id")
PAIRS = "pair_id string, skill string, conflict string, first string, second string, rationale string"
STUDIES = "study_id string, assistant string, rollouts int, input1 struct<instruction:string,framing:string,channel:string,author:string>, input2 struct<instruction:string,framing:string,channel:string,author:string>"


@dataclass(frozen=True)
class AxisOrder:
    """Order, reference levels and roles of the axes' levels of a data set."""

    framing: tuple[str, ...] = FRAMINGS
    channel: tuple[str, ...] = CHANNELS
    author: tuple[str, ...] = AUTHORS
    framing_reference: tuple[str, ...] = ("normal",)
    channel_reference: tuple[str, ...] = (USER_CHANNEL,)
    author_reference: tuple[str, ...] = AUTHORS[1:]
    reasoning: tuple[str, ...] = REASONING_FRAMINGS
    descriptive: tuple[str, ...] = DESCRIPTIVE_FRAMINGS
    manual: tuple[str, ...] = MANUAL_FRAMINGS


def axis_dimension(spark: SparkSession, order: AxisOrder | None = None) -> DataFrame:
    """(axis, value, ordinal): every level in declared order."""
    rows = [(axis, value, k) for axis in AXES for k, value in enumerate(getattr(order or AxisOrder(), axis))]
    return literal(spark, rows, "axis string, value string, ordinal int")
