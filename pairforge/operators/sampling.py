"""Connected, stratified samples of a pair's edges with even degrees.

One pair is one task: its edges are bounded by the design. Numbers are drawn from a generator that is
seeded by the pair alone, so a pair's sample does not depend on where or when it is drawn.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.design import DEFAULT_PAIRINGS, STRATUM, stratum
from pairforge.shared import ship

CHOICES = 8


@dataclass(frozen=True)
class Edge:
    a: int
    b: int
    stratum: tuple
    channels: tuple[str, str]


class Forest:
    """Disjoint sets with path halving."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[y] = x
        return x != y


def pair_seed(seed: int, pair_id: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{pair_id}".encode()).digest()[:8], "big")


def quotas(sizes: dict[tuple, int], wanted: int) -> dict[tuple, int]:
    """Proportional shares; what floors leave goes to the largest remainders, then by key."""
    population = sum(sizes.values())
    share = {s: wanted * n // population for s, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda s: (-(wanted * sizes[s] % population), s))
    for s in by_remainder[: wanted - sum(share.values())]:
        share[s] += 1
    return share


def draw(edges: list[Edge], nodes: int, channel_of: list[str], share: dict[tuple, int], rng: Random) -> list[int]:
    """Fill the strata in random order, each time with the edge of a few that loads its nodes least.

    A node's load is its degree against the mean degree that the shares give its channel.
    """
    pools: dict[tuple, list[int]] = defaultdict(list)
    for k, e in enumerate(edges):
        if share[e.stratum]:
            pools[e.stratum].append(k)
    ends = Counter()
    for s, q in share.items():
        ends[s[0]] += q
        ends[s[1]] += q
    of_channel = Counter(channel_of)
    target = {c: ends[c] / n if ends[c] else 1.0 for c, n in of_channel.items()}
    for s in sorted(pools):
        rng.shuffle(pools[s])
    turns = [s for s in sorted(share) for _ in range(share[s])]
    rng.shuffle(turns)
    degree, taken = [0] * nodes, []
    for s in turns:
        pool = pools[s]

        def load(at: int, pool: list[int] = pool) -> tuple[float, float, int]:
            e = edges[pool[at]]
            x = [(degree[v] + 1) / target[channel_of[v]] for v in (e.a, e.b)]
            return max(x), sum(x), at

        at = min(rng.sample(range(len(pool)), min(CHOICES, len(pool))), key=load)
        pool[at], pool[-1] = pool[-1], pool[at]
        k = pool.pop()
        degree[edges[k].a] += 1
        degree[edges[k].b] += 1
        taken.append(k)
    return taken


def connect(edges: list[Edge], nodes: int, taken: list[int], rng: Random) -> list[int]:
    """Swap as few edges as possible so that the sample connects all nodes.

    A spanning forest of the sample stays; every further component is bridged by an eligible edge, and
    an edge that closes a cycle makes room, one of the bridge's stratum if there is any.
    """
    forest, order = Forest(nodes), sorted(taken)
    rng.shuffle(order)
    spare = [k for k in order if not forest.join(edges[k].a, edges[k].b)]
    bridges = []
    held = set(taken)
    for k, e in enumerate(edges):
        if k not in held and forest.root(e.a) != forest.root(e.b):
            forest.join(e.a, e.b)
            bridges.append(k)
    if len({forest.root(v) for v in range(nodes)}) > 1:
        raise ValueError("the eligible edges do not connect the cells")
    for k in bridges:
        same = [x for x in spare if edges[x].stratum == edges[k].stratum]
        out = same[-1] if same else spare[-1]
        spare.remove(out)
        held.remove(out)
        held.add(k)
    return sorted(held)


def sample_edges(edges: list[Edge], nodes: int, channel_of: list[str], wanted: int, seed: int) -> list[int]:
    """Places of the sampled edges; all of them, without any draw, if all are wanted."""
    if not nodes - 1 <= wanted <= len(edges):
        raise ValueError(f"pairings must be from {nodes - 1} to {len(edges)}")
    if wanted == len(edges):
        return list(range(len(edges)))
    rng = Random(seed)
    share = quotas(dict(Counter(e.stratum for e in edges)), wanted)
    return connect(edges, nodes, draw(edges, nodes, channel_of, share, rng), rng)


def sample_pairs(edges: DataFrame, seed: int, pairings: int | None = None) -> DataFrame:
    """Sampled rows of ranked edges (see design.ranked_edges), pair by pair."""
    ship(edges.sparkSession)
    columns = edges.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        place: dict[tuple[int, int], int] = {}
        channel_of: list[str] = []
        listed = []
        for r in rows.to_dict("records"):
            ends = []
            for side in (1, 2):
                key = (side, r[f"spec_no{side}"])
                if key not in place:
                    place[key] = len(place)
                    channel_of.append(r[f"channel{side}"])
                ends.append(place[key])
            listed.append(Edge(*ends, tuple(r[c] for c in STRATUM), (r["channel1"], r["channel2"])))
        wanted = pairings or min(len(listed), max(DEFAULT_PAIRINGS, len(place) - 1))
        picked = sample_edges(listed, len(place), channel_of, wanted, pair_seed(seed, rows["pair_id"].iloc[0]))
        return rows.loc[picked, columns]

    flags = stratum()[2:]
    return edges.select("*", *flags).groupBy("pair_id").applyInPandas(run, edges.schema)


def sampled_studies(edges: DataFrame, assistants: tuple[str, ...], seed: int, rollouts: int = 1, pairings: int | None = None) -> DataFrame:
    """One sampled design for every assistant, as studies."""
    picked = sample_pairs(edges, seed, pairings)
    spec = lambda k: F.struct(*(F.col(f"{c}{k}").alias(c) for c in ("instruction", "framing", "channel", "author"))).alias(f"input{k}")
    rows = picked.select("pair_id", "rank", spec(1), spec(2)).withColumn("assistant", F.explode(F.array(*map(F.lit, assistants))))
    study = F.substring(F.sha2(F.to_json(F.struct("assistant", "input1", "input2", F.lit(rollouts).alias("rollouts"))), 256), 1, 12)
    return rows.select(study.alias("study_id"), "pair_id", "assistant", F.lit(rollouts).alias("rollouts"), "input1", "input2")
