"""Resampling without the driver: weights of replicates are made where the rows are, from counters.

Two kinds of draws. Weights of single rows are independent Poisson(1) numbers, functions of (seed, replicate, row), so all
rows of a conversation agree without any exchange; their sum varies about the number of rows, which ratios such as an AUC
do not see. Counts of groups are exact: drawing n of n trials is a tree of conditional binomials over ranges of trials, and a
task walks down from the root to its own range, so counts of all groups add up to n in every replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.shared import materialize, ship


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to 64-bit numbers, one to one, each bit of the input on all of the output."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def poisson_table() -> np.ndarray:
    """For each 16-bit number the Poisson(1) count of that quantile."""
    steps, p, total = [], np.exp(-1.0), 0.0
    for k in range(1, 12):
        total += p
        steps.append(total * 65536)
        p /= k
    return np.searchsorted(np.array(steps), np.arange(65536) + 0.5).astype(np.uint8)


def poisson_weights(keys: np.ndarray, lo: int, hi: int, seed: int, table: np.ndarray) -> np.ndarray:
    """(rows, hi - lo): weights of replicates lo to hi - 1 for rows of these keys. lo is a multiple of four."""
    blocks = np.arange(lo // 4, -(-hi // 4), dtype=np.uint64)
    salts = mixed(blocks * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64)))
    bits = mixed(mixed(keys.astype(np.uint64))[:, None] ^ salts[None, :])
    return table[bits.view(np.uint16)][:, : hi - lo]


STATES = "score double, tied boolean, replicate int, p long, n long, u double"


def _segment_states(replicates: int, seed: int, cells: int):
    """States of a part's rows for every replicate: weights of positive and negative rows, and of pairs in the right order.

    A score that very many rows share is a segment of its own, as its rows may lie in several parts.
    """
    names = [c.split()[0] for c in STATES.split(", ")]

    def segment(key: np.ndarray, score: np.ndarray, positive: np.ndarray, tied: bool, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
        width = max(4, min(replicates, cells // len(key)) // 4 * 4)
        for lo in range(0, replicates, width):
            hi = min(replicates, lo + width)
            w = poisson_weights(key, lo, hi, seed, table)
            if lo == 0:
                w[:, 0] = 1
            p = np.add.reduceat(np.where(positive[:, None], w, 0), starts, axis=0, dtype=np.int64)
            n = np.add.reduceat(np.where(positive[:, None], 0, w), starts, axis=0, dtype=np.int64)
            below = np.cumsum(n, axis=0) - n
            u = (p * (below + n / 2)).sum(0)
            size = hi - lo
            yield pa.record_batch([pa.array(np.full(size, score[0])), pa.array(np.full(size, tied)), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(p.sum(0)), pa.array(n.sum(0)), pa.array(u)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "score", "positive", "tied")) for b in batches if b.num_rows]
        if not parts:
            return
        key, score, positive, tied = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((tied, score))
        key, score, positive, tied = key[order], score[order], positive[order].astype(bool), tied[order].astype(bool)
        cut = np.concatenate(([True], (tied[1:] != tied[:-1]) | (tied[1:] & (score[1:] != score[:-1])), [True]))
        edges, table = np.flatnonzero(cut), poisson_table()
        for a, b in zip(edges, edges[1:], strict=False):
            yield from segment(key[a:b], score[a:b], positive[a:b], bool(tied[a]), table)

    return run


@dataclass(frozen=True)
class BootstrapConfig:
    replicates: int = 10_000
    seed: int = 0
    #: Rows of a part, and of one score beyond which it is dealt out over several.
    part: int = 65_536
    #: Rows times replicates that a task holds at once.
    cells: int = 1 << 22


def auc_replicates(pairs: DataFrame, cfg: BootstrapConfig | None = None) -> DataFrame:
    """(replicate, auc): the AUC itself as replicate 0, then those of resampled conversations.

    pairs: conversation, reasoning, final; pairs that lack a score take no part. Both rows of a conversation have its weight. Rows
    are dealt out by ranges of scores; a part sends three numbers a replicate, and running sums over parts give the AUC.
    """
    cfg, spark = cfg or BootstrapConfig(), pairs.sparkSession
    ship(spark)
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    both = F.explode(F.array(*(F.struct(F.col(c).cast("double").alias("score"), F.lit(c == "reasoning").alias("positive")) for c in ("reasoning", "final"))))
    rows = pairs.where(usable("reasoning") & usable("final")).select(F.xxhash64("conversation").alias("key"), both.alias("x")).select("key", (F.col("x.score") + 0.0).alias("score"), "x.positive")
    rows, _ = materialize(spark, rows, "scores")
    parts = max(1, -(-rows.count() // cfg.part))
    # At most as many scores as there are parts have more rows than a part, so the broadcast is bounded.
    common = rows.groupBy("score").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > cfg.part).select("score", F.lit(True).alias("tied"))
    flagged = rows.join(F.broadcast(common), "score", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    dealt = flagged.repartitionByRange(parts, "score", F.when(F.col("tied"), F.xxhash64("key")).otherwise(F.lit(0).cast("long")))
    states = dealt.select("key", "score", "positive", "tied").mapInArrow(_segment_states(cfg.replicates + 1, cfg.seed, cfg.cells), STATES)
    merged = states.groupBy("replicate", "score", "tied").agg(*(F.sum(c).alias(c) for c in "pnu"))
    merged = merged.withColumn("u", F.when(F.col("tied"), F.col("p") * F.col("n") / 2.0).otherwise(F.col("u")))
    earlier = Window.partitionBy("replicate").orderBy("score", "tied").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.sum(F.col("u") + F.col("p") * F.col("before"))
    return merged.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("replicate").agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def paired_bootstrap(pairs: DataFrame, cfg: BootstrapConfig | None = None) -> DataFrame:
    """One row: test_auc, lower_95 and upper_95 over resampled conversations, and how many conversations there are.

    Without conversations the figures are null.
    """
    again = F.when(F.col("replicate") > 0, F.col("auc"))
    out = auc_replicates(pairs, cfg).agg(F.max(F.when(F.col("replicate") == 0, F.col("auc"))).alias("test_auc"), F.percentile(again, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    counted = pairs.agg(F.count(F.lit(1)).alias("conversations"))
    return out.join(counted, how="cross").select("test_auc", F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("upper_95"), "conversations")


def drawn_below(x: int, total: int, seed: int, lo: int, hi: int) -> np.ndarray:
    """For replicates lo to hi - 1: how many of `total` draws among as many trials fall on trials before number x.

    A path down a tree of halves of the trials; a range's draws in its first half are binomial, the same for whoever asks.
    """
    below, here = np.zeros(hi - lo, np.int64), np.full(hi - lo, total, np.int64)
    a, b = 0, total
    while a < x < b:
        middle = (a + b) // 2
        first = np.random.default_rng([seed, lo, hi, a, b]).binomial(here, (middle - a) / (b - a))
        if x >= middle:
            below, here, a = below + first, here - first, middle
        else:
            here, b = first, middle
    return below + here if x >= b else below


def drawn_within(before: int, size: int, total: int, seed: int, lo: int, hi: int) -> np.ndarray:
    """Draws on trials before to before + size - 1, for replicates lo to hi - 1."""
    return drawn_below(before + size, total, seed, lo, hi) - drawn_below(before, total, seed, lo, hi)
