"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the standard deviation are kept. The squared
distance of two vectors is at least the sum over segments of length times the squared differences of
means and of deviations; with the norms, that bounds their inner product from above. Bounds are taken
with few segments first, then with more for what is left, and exact products only for survivors.

A first pass gives each query a threshold, its k-th best product within a bounded seed sample; any
candidate below it cannot be in the answer. Then every partition of candidates meets all queries in
blocks that it streams from the shared folder, so neither side is shuffled or held whole, and sends on
at most k rows per query and block. Products are exact integers.

Every row is a candidate, or, with `distinct`, every id: then an id's best row stands for it before
places are counted, in the threshold and in each block. The query takes every row, as its SQL does.

Defined results: null ids, null vectors and vectors with null or non-finite components take no part;
a candidate with the query's own id is passed over; vectors of unequal length are not compared; rows
that repeat an id count once, with their best score, or each, without `distinct`; a query without candidates has no rows; products beyond 64 bits
are held at the limits; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class SearchConfig:
    k: int = 20
    scale: int = 64
    levels: tuple[int, ...] = (4, 16)
    seeds: int = 4096
    query_block: int = 512
    candidate_block: int = 16_384
    distinct: bool = True


def segment_features(v: np.ndarray, segments: int) -> np.ndarray:
    """Root-length-weighted means and deviations: their products bound the vectors' product."""
    n, d = v.shape
    edges = np.linspace(0, d, min(segments, max(1, d)) + 1).astype(int)
    out = np.empty((n, 2 * (len(edges) - 1)))
    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part, weight = v[:, a:b], np.sqrt(b - a)
        out[:, 2 * s] = part.mean(1) * weight
        out[:, 2 * s + 1] = part.std(1) * weight
    return out


class Block:
    """Vectors of one length as floats, with features of each level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: tuple[int, ...]):
        self.ids, self.ints = ids, vectors
        self.repeats = np.unique(ids).size < ids.size
        self.vectors = vectors.astype(np.float64)
        self.features = [segment_features(self.vectors, s) for s in levels] if vectors.shape[1] else []
        self.largest = float(np.abs(self.vectors).max(initial=0.0))
        self.norm = np.sqrt((self.vectors**2).sum(1))

    def exact(self, rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
        if small:
            return (self.vectors[rows] @ query.astype(np.float64)).astype(np.int64)
        wide = self.ints[rows].astype(object) @ query.astype(object) if len(rows) else np.empty(0, object)
        return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64) if len(rows) else np.empty(0, np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.size > 4 * k:
        least = np.partition(scores, scores.size - k)[scores.size - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(scores.size)
    return keep[np.lexsort((ids[keep], -scores[keep].astype(object) if scores.size and scores.min() == -(1 << 63) else -scores[keep]))[:k]]


def best_of_each(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of one highest score of each id."""
    order = np.lexsort((scores, ids))
    return order[np.append(ids[order][1:] != ids[order][:-1], True)] if order.size else order


def search_block(queries: Block, thresholds: np.ndarray, candidates: Block, k: int, distinct: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best candidates at or above its threshold: query id, ids, scores."""
    small = queries.largest * candidates.largest * max(1, candidates.vectors.shape[1]) < 2**52
    coarse = queries.features[0] @ candidates.features[0].T if candidates.features and small else None
    for row, query_id in enumerate(queries.ids.tolist()):
        least = thresholds[row]
        if coarse is None:
            left = np.arange(candidates.ids.size)
        else:
            slack = 1e-9 * (1.0 + queries.norm[row] * candidates.norm.max(initial=0.0))
            left = np.flatnonzero(coarse[row] >= least - slack)
            for mine, theirs in zip(queries.features[1:], candidates.features[1:], strict=True):
                left = left[theirs[left] @ mine[row] >= least - slack]
        left = left[candidates.ids[left] != query_id]
        scores = candidates.exact(left, queries.ints[row], small)
        keep = scores >= least
        left, scores = left[keep], scores[keep]
        if scores.size:
            if distinct and candidates.repeats:
                one = best_of_each(candidates.ids[left], scores)
                left, scores = left[one], scores[one]
            top = best(candidates.ids[left], scores, k)
            yield query_id, candidates.ids[left[top]], scores[top]


def _blocks(ids: np.ndarray, lists: pa.ListArray, size: int, levels: tuple[int, ...]) -> Iterator[tuple[np.ndarray, Block]]:
    """Blocks of equal-length vectors, with their rows' places."""
    lists = pa.concat_arrays([lists])
    lengths = np.asarray(lists.value_lengths())
    flat, start = np.asarray(lists.values), np.asarray(lists.offsets)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        for a in range(0, rows.size, size):
            part = rows[a : a + size]
            yield part, Block(ids[part], flat[start[part][:, None] + np.arange(d)], levels)


def _stored(uri: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    yield from ds.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False).to_batches(columns=columns, batch_size=8192)


def _threshold_kernel(uri: str, cfg: SearchConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in _stored(uri, ["vec_id", "v"]) if b.num_rows]
        ids = np.concatenate([np.asarray(b.column(0)) for b in found]) if found else np.empty(0, np.int64)
        lists = pa.concat_arrays([b.column(1) for b in found]) if found else pa.array([], pa.list_(pa.int64()))
        seeds = [b for _, b in _blocks(ids, lists, len(ids) or 1, ())] if len(ids) else []
        for batch in batches:
            least = np.full(batch.num_rows, -(1 << 63), np.int64)
            for rows, block in _blocks(np.asarray(batch.column(0)), batch.column(1), cfg.query_block, ()):
                for seed in seeds:
                    if seed.ints.shape[1] != block.ints.shape[1] or block.largest * seed.largest * max(1, block.ints.shape[1]) >= 2**52:
                        continue
                    scores = block.vectors @ seed.vectors.T
                    scores[block.ids[:, None] == seed.ids[None, :]] = -np.inf
                    if cfg.distinct and seed.repeats:
                        order = np.argsort(seed.ids, kind="stable")
                        scores = np.maximum.reduceat(scores[:, order], np.unique(seed.ids[order], return_index=True)[1], axis=1)
                    if scores.shape[1] > cfg.k:
                        cut = np.partition(scores, scores.shape[1] - cfg.k, axis=1)[:, scores.shape[1] - cfg.k]
                        least[rows] = np.where(np.isfinite(cut), cut, -(2.0**63)).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(least)], names=["vec_id", "v", "least"])

    return run


def _search_kernel(uri: str, cfg: SearchConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            ids = np.concatenate([np.asarray(b.column(0)) for b in held])
            own = [b for _, b in _blocks(ids, pa.concat_arrays([b.column(1) for b in held]), cfg.candidate_block, cfg.levels)]
            for stored in _stored(uri, ["vec_id", "v", "least"]):
                if not stored.num_rows:
                    continue
                least = np.asarray(stored.column(2))
                for rows, queries in _blocks(np.asarray(stored.column(0)), stored.column(1), cfg.query_block, cfg.levels):
                    got = [x for c in own if c.ints.shape[1] == queries.ints.shape[1] for x in search_block(queries, least[rows], c, cfg.k, cfg.distinct)]
                    if got:
                        count = [x[1].size for x in got]
                        yield pa.record_batch([pa.array(np.repeat([x[0] for x in got], count)), pa.array(np.concatenate([x[1] for x in got])), pa.array(np.concatenate([x[2] for x in got]))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for a in range(0, batch.num_rows, cfg.candidate_block):
                held.append(batch.slice(a, cfg.candidate_block))
                size += held[-1].num_rows
                if size >= cfg.candidate_block:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", cfg: SearchConfig | None = None) -> DataFrame:
    """The k best candidates of each row for which is_query(id) holds: query_id, rank, vec_id, score."""
    spark, cfg = df.sparkSession, cfg or SearchConfig()
    common.ship(spark)
    x = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(cfg.scale)))).alias("v"))
    _, seeds = common.materialize(spark, rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.seeds), "seeds")
    queries = rows.where(is_query(F.col("vec_id"))).mapInArrow(_threshold_kernel(seeds, cfg), "vec_id long, v array<long>, least long")
    _, stored = common.materialize(spark, queries, "queries")
    found = rows.mapInArrow(_search_kernel(stored, cfg), "query_id long, vec_id long, score long")
    if cfg.distinct:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, cfg=SearchConfig(distinct=False))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
