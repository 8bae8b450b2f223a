"""Designs: prompt specifications, eligible edges and their strata, trials, probe requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions.text import trial_id
from pairforge.operators.validate import writable
from pairforge.schema import AUTHORS, CHANNELS, FRAMINGS, USER_CHANNEL
from pairforge.shared import literal

DEFAULT_PAIRINGS = 720
SPEC = ("instruction", "framing", "channel", "author")


def _dimension(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return literal(spark, [(v, k) for k, v in enumerate(values)], f"{name} string, {name}_no int")


def prompt_specs(instructions: DataFrame, authors: tuple[str, ...] = AUTHORS, framings: tuple[str, ...] = FRAMINGS, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Every allowed specification of each instruction, numbered in declared order.

    The axes are fixed lists of a few levels each, broadcast as one small table.
    """
    spark = instructions.sparkSession
    axes = _dimension(spark, "framing", framings).crossJoin(_dimension(spark, "channel", channels)).crossJoin(_dimension(spark, "author", authors))
    axes = axes.where(writable(F.col("author"), F.col("framing")))
    n_c, n_a = len(channels), len(authors)
    number = (F.col("framing_no") * n_c + F.col("channel_no")) * n_a + F.col("author_no")
    return instructions.crossJoin(F.broadcast(axes)).withColumn("spec_no", number).drop("framing_no", "channel_no", "author_no")


def pair_specs(bank: DataFrame, **kwargs) -> DataFrame:
    """Specifications of both sides of every pair."""
    sides = bank.select("pair_id", F.expr("stack(2, 'first', first, 'second', second) as (side, instruction)"))
    return prompt_specs(sides, **kwargs)


def valid_edge(channel1: Column, channel2: Column) -> Column:
    return (channel1 == USER_CHANNEL) | (channel2 == USER_CHANNEL)


def eligible_edges(specs: DataFrame) -> DataFrame:
    """Every allowed pairing of a first-side with a second-side specification of the same pair."""
    side = lambda s, k: specs.where(F.col("side") == s).select("pair_id", *(F.col(c).alias(f"{c}{k}") for c in (*SPEC, "spec_no")))
    return side("first", 1).join(side("second", 2), "pair_id").where(valid_edge(F.col("channel1"), F.col("channel2")))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Adds rank: user-channel first sides with all second sides, then the others with user seconds."""
    user1 = (F.col("channel1") == USER_CHANNEL).cast("int")
    order = Window.partitionBy("pair_id").orderBy(F.desc(user1), "spec_no1", "spec_no2")
    return edges.withColumn("rank", F.row_number().over(order) - 1)


def stratum() -> list[Column]:
    return [F.col("channel1"), F.col("channel2"), (F.col("framing1") != F.col("framing2")).alias("framing_differs"), (F.col("author1") != F.col("author2")).alias("author_differs")]


STRATUM = ["channel1", "channel2", "framing_differs", "author_differs"]


def edge_strata(edges: DataFrame) -> DataFrame:
    return edges.select("pair_id", *stratum()).groupBy("pair_id", *STRATUM).agg(F.count(F.lit(1)).alias("edges"))


def pairing_counts(specs: DataFrame) -> DataFrame:
    """Nodes, population, fewest connecting edges and default sample of each pair, without its edges."""
    user = F.col("channel") == USER_CHANNEL
    by_side = lambda s: F.count_if(F.col("side") == s)
    other = lambda s: F.count_if((F.col("side") == s) & ~user)
    out = specs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("nodes"), (by_side("first") * by_side("second") - other("first") * other("second")).alias("population"))
    least = F.col("nodes") - 1
    return out.select("pair_id", "nodes", "population", least.alias("minimum_connected"), F.least("population", F.greatest(F.lit(DEFAULT_PAIRINGS), least)).alias("default_pairings"))


def strata_quotas(strata: DataFrame, counts: DataFrame) -> DataFrame:
    """Largest-remainder shares of the default sample: floors first, then the largest remainders."""
    rows = strata.join(counts.select("pair_id", "population", "default_pairings"), "pair_id")
    scaled = F.col("default_pairings") * F.col("edges")
    rows = rows.withColumn("floor", F.floor(scaled / F.col("population"))).withColumn("remainder", scaled % F.col("population"))
    pair = Window.partitionBy("pair_id")
    rows = rows.withColumn("left", F.col("default_pairings") - F.sum("floor").over(pair))
    place = F.row_number().over(pair.orderBy(F.desc("remainder"), *STRATUM))
    return rows.withColumn("place", place).select("pair_id", *STRATUM, "edges", (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def build_trials(studies: DataFrame) -> DataFrame:
    """Both orders and every rollout of each study."""
    rows = studies.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("permutation")).select("*", F.explode(F.sequence(F.lit(1), F.col("rollouts"))).alias("rollout"))
    swap = F.col("permutation") == 2
    return rows.select(
        trial_id(F.col("study_id"), F.col("permutation"), F.col("rollout")).alias("trial_id"),
        "study_id",
        "permutation",
        "rollout",
        "assistant",
        F.when(swap, F.col("input2")).otherwise(F.col("input1")).alias("input1"),
        F.when(swap, F.col("input1")).otherwise(F.col("input2")).alias("input2"),
    )


def probe_requests(studies: DataFrame) -> DataFrame:
    """Four requests a study: both permutations and positions, with the input that is shown there."""
    both = F.array(F.lit(1), F.lit(2))
    rows = studies.select("study_id", "assistant", F.explode(both).alias("permutation"), "input1", "input2").select("*", F.explode(both).alias("position"))
    shown = F.when(F.col("permutation") == F.col("position"), F.lit(1)).when((F.col("permutation") == 1), F.lit(2)).otherwise(F.when(F.col("position") == 1, F.lit(2)).otherwise(F.lit(1)))
    return rows.select("study_id", "assistant", "permutation", "position", shown.alias("input_index"), F.when(shown == 1, F.col("input1")).otherwise(F.col("input2")).alias("spec"))


def ragged_pairs(counts: DataFrame) -> DataFrame:
    """Populations, if pairs differ in them; empty for an even design."""
    sizes = counts.groupBy("population").agg(F.count(F.lit(1)).alias("pairs"))
    return sizes.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("kinds > 1").drop("kinds")


def with_assistants(studies: DataFrame, assistants: tuple[str, ...]) -> DataFrame:
    """One design for every assistant; the list is fixed and short."""
    return studies.drop("assistant").withColumn("assistant", F.explode(F.array(*map(F.lit, assistants))))


def channel_degrees(quotas: DataFrame, specs: DataFrame) -> DataFrame:
    """Mean degree that the quotas give a node of each pair and channel."""
    ends = quotas.select("pair_id", F.explode(F.array("channel1", "channel2")).alias("channel"), "quota").groupBy("pair_id", "channel").agg(F.sum("quota").alias("ends"))
    nodes = specs.groupBy("pair_id", "channel").agg(F.count(F.lit(1)).alias("nodes"))
    degree = F.coalesce(F.try_divide(F.col("ends"), F.col("nodes")), F.lit(0.0))
    return nodes.join(ends, ["pair_id", "channel"], "left").select("pair_id", "channel", "nodes", F.when(degree > 0, degree).otherwise(1.0).alias("target_degree"))


def edge_of_rank(rank: Column, first_user: Column, first_other: Column, second: Column, second_user: Column) -> Column:
    """Ordinals (side one, side two) of an edge: user firsts with all seconds, then other firsts with user seconds."""
    block = first_user * second
    rest = rank - block
    return F.when(rank < block, F.struct(F.floor(rank / second).alias("first"), (rank % second).alias("second"))).otherwise(F.struct((first_user + F.floor(rest / second_user)).alias("first"), (rest % second_user).alias("second")))


def expected_judge_rows(studies: DataFrame) -> DataFrame:
    """Four coordinates a study, each with the input that stands there: orders mirror positions."""
    return probe_requests(studies).select("study_id", "assistant", "permutation", "position", "input_index")
