"""Prediction by partial matching over bytes, with symbol exclusion, trained on the corpus.

The trie of byte contexts is kept as tables, one for each order: (context and symbol, count). At each
order the symbol is coded if the context has seen it, else an escape is; the estimates are those of
PPM method D (of n occurrences of a symbol, half a one goes to the escape), and symbols that a longer
context has seen are excluded from the shorter ones. A text's score is the log10 probability of its bytes (A-Z lower-cased)
and of its end under the counts of all training texts.

Rows are dealt into blocks of bounded size by a hash of id and text, so an id that many texts share is many keys. A block reports each distinct (context, symbol)
and word once, with its training count; counts are added over blocks; the trie's tables are joined
level by level to value what was never seen in training; values go back to the blocks that asked, and
a block sums them over its texts. Counts of words go back only where they are not the block's own. Every table is keyed by context or block, none is collected; what is
broadcast is keyed by at most two bytes, 65,536 rows. What is gathered grows with the corpus.

Words of the base score are told apart by 62 bits of hash.

Defined results: null text counts as empty and still has its end; a null id counts as training; an
empty training set gives each symbol 1/256; repeated rows are each counted and answered; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class PpmConfig:
    order: int = 5
    block_bytes: int = 24 << 20
    least_block: int = 4 << 20
    slice_bytes: int = 1 << 20


#: Bytes that no UTF-8 text holds: what precedes a text, and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
WORD_BIT, END_WORD = 1 << 62, 1 << 61


def mask(order: int) -> int:
    """Keeps the symbol and the nearest `order` bytes of a key."""
    return (1 << 8 * (order + 1)) - 1


def gram_keys(texts: list[bytes], order: int) -> np.ndarray:
    """Key (context, then symbol) of every byte and end of the texts, in order."""
    pad = bytes([BEFORE]) * order
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([END]))), np.uint8)
    wide = raw.astype(np.uint64)
    n = raw.size - order
    out = np.zeros(max(0, n), np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | wide[k : k + n]
    return out[raw[order:] != BEFORE]


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and key of every word."""
    start, h = common.word_spans(b"\n".join(texts))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(first, start, "right") - 1, (h >> np.uint64(2)) | np.uint64(WORD_BIT)


def _slices(table: pa.Table | pa.RecordBatch, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Row of the first text and the texts, lower-cased, of each part of a block."""
    texts, part, size, first = table.column("text"), [], 0, 0
    for k in range(table.num_rows):
        part.append(texts[k].as_py().encode().lower())
        size += len(part[-1])
        if size >= most:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not key.size:
        return key, count
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count[order], first)


def _summarise(cfg: PpmConfig):
    """Distinct keys of a block with their training counts; its texts stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, block = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            held, block = np.asarray(batch.column("held_out").cast(pa.int8())).astype(bool), batch.column("block")[0].as_py()
            for first, part in _slices(batch, cfg.slice_bytes):
                for out in (False, True):
                    mine = [t for t, h in zip(part, held[first : first + len(part)].tolist(), strict=True) if h == out]
                    if not mine:
                        continue
                    for found in (gram_keys(mine, cfg.order), word_keys(mine)[1], np.full(len(mine), END_WORD, np.uint64)):
                        k, c = np.unique(found, return_counts=True)
                        keys.append(k)
                        counts.append(c * (not out))
                if len(keys) > 12:
                    k, c = _added(keys, counts)
                    keys, counts = [k], [c]
        k, c = _added(keys, counts)
        del keys, counts
        for a in range(0, k.size, 100_000):
            part_k, part_c = k[a : a + 100_000], c[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part_k.size, block, np.int64)), pa.array(part_k.view(np.int64)), pa.array(part_c)], names=["block", "key", "n"])

    return run


class Lookup:
    """Values by 64-bit keys: two hashed tables, the few keys left over by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            shift = 64 - max(10, int(2 * keys.size).bit_length())
            slot = self._slot(keys, salt, shift)
            held, value = np.full(1 << 64 - shift, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(1 << 64 - shift)
            held[slot], value[slot] = keys, values
            self.tables.append((salt, shift, held, value))
            left = held[slot] != keys
            keys, values = keys[left], values[left]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, shift: int) -> np.ndarray:
        return ((keys * np.uint64(salt)) >> np.uint64(shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and which keys are there."""
        out, there = np.zeros(keys.size), np.zeros(keys.size, bool)
        rest = np.arange(keys.size)
        for salt, shift, held, value in self.tables:
            slot = self._slot(keys[rest], salt, shift)
            hit = held[slot] == keys[rest]
            out[rest[hit]], there[rest[hit]] = value[slot[hit]], True
            rest = rest[~hit]
        if self.keys.size and rest.size:
            at = np.minimum(np.searchsorted(self.keys, keys[rest]), self.keys.size - 1)
            hit = self.keys[at] == keys[rest]
            out[rest[hit]], there[rest[hit]] = self.values[at[hit]], True
        return out, there


OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _own_words(docs: pa.Table, cfg: PpmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block's training texts, their ends among them, and how often they occur."""
    held = np.asarray(docs.column("held_out"))
    keys, counts = [np.array([END_WORD], np.uint64)], [np.array([(~held).sum()], np.int64)]
    for first, part in _slices(docs, cfg.slice_bytes):
        k, c = np.unique(word_keys([t for t, h in zip(part, held[first : first + len(part)].tolist(), strict=True) if not h])[1], return_counts=True)
        keys.append(k)
        counts.append(c)
        if len(keys) > 24:
            k, c = _added(keys, counts)
            keys, counts = [k], [c]
    return _added(keys, counts)


def _score(cfg: PpmConfig, total: int, distinct: int):
    denominator = total + 0.1 * (distinct + 1)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        keys, value = np.asarray(values.column("key")).view(np.uint64), np.asarray(values.column("value"))
        is_word = keys >= np.uint64(END_WORD)
        grams = Lookup(keys[~is_word], value[~is_word])
        own, count = _own_words(docs, cfg)
        alone = ~np.isin(own, keys[is_word])
        words = Lookup(np.concatenate((own[alone], keys[is_word])), np.concatenate((count[alone], value[is_word])))
        del keys, value, own, count
        ends = float(words.get(np.array([END_WORD], np.uint64))[0][0])
        columns: list[list[np.ndarray]] = [[] for _ in range(4)]
        for _, part in _slices(docs, cfg.slice_bytes):
            n = len(part)
            of, found = word_keys(part)
            count, _ = words.get(found)
            known = count > 0
            tokens = np.bincount(of, minlength=n) + 1
            base = np.bincount(of, np.log10((count + 0.1) / denominator), n) + np.log10((ends + 0.1) / denominator)
            logs, _ = grams.get(gram_keys(part, cfg.order))
            start = np.cumsum([0, *(len(t) + 1 for t in part)])[:-1]
            for c, x in zip(columns, (tokens, np.bincount(of[known], minlength=n) + (ends > 0), base, np.add.reduceat(logs, start)), strict=True):
                c.append(x)
        tokens, known, base, score = (np.concatenate(c) for c in columns)
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": whole(tokens), "n_known": whole(known), "train_tokens": pa.array(np.full(tokens.size, total, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def trie_levels(spark, grams: DataFrame, order: int, paths: list[str]) -> list[DataFrame]:
    """Level k: (key, n) with key of k context bytes and a symbol, for k = 0 .. order.

    paths gets the tables that are written.
    """
    levels = [grams.where("n > 0").select("key", "n")]
    for k in range(order - 1, -1, -1):
        lower = levels[0].groupBy(F.col("key").bitwiseAND(F.lit(mask(k))).alias("key")).agg(F.sum("n").alias("n"))
        level, path = common.materialize(spark, lower, f"ppm-level-{k}")
        levels.insert(0, level)
        paths.append(path)
    return levels


def value_grams(spark, grams: DataFrame, order: int, paths: list[str]) -> DataFrame:
    """(key, value): log10 probability of each key's symbol after its context; n = 0 means unseen."""
    levels = trie_levels(spark, grams, order, paths)
    context = F.shiftright("key", 8).alias("context")
    nodes = [level.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")) for level in levels]
    distinct_symbols = levels[0].count()
    low = lambda k: F.col("key").bitwiseAND(F.lit(mask(k)))
    small = lambda df, bytes_of_key: F.broadcast(df) if bytes_of_key <= 2 else df
    top = grams.join(nodes[order].withColumnRenamed("context", "c"), F.shiftright("key", 8) == F.col("c"), "left")
    top, path = common.materialize(spark, top.select("key", "n", "total", "kinds"), "ppm-top")
    paths.append(path)
    seen = top.where("n > 0").select("key", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("value"))
    escape = F.when(F.col("kinds") > 0, F.log10(F.col("kinds") / (2 * F.col("total")))).otherwise(F.lit(0.0))
    rest = top.where("n = 0").select("key", escape.alias("acc"), F.lit(None).cast("double").alias("value"))
    for k in range(order - 1, -1, -1):
        below = levels[k].select(F.col("key").alias("k_key"), F.col("n").alias("k_n"))
        excluded = levels[k + 1].join(small(below, k + 1), low(k) == F.col("k_key")).groupBy(F.shiftright("key", 8).alias("x_context")).agg(F.sum("k_n").alias("out_total"), F.count(F.lit(1)).alias("out_kinds"))
        node = nodes[k].select(F.col("context").alias("n_context"), "total", "kinds")
        rest = rest.join(small(below, k + 1), low(k) == F.col("k_key"), "left")
        rest = rest.join(small(node, k), F.shiftright(low(k), 8) == F.col("n_context"), "left")
        rest = rest.join(small(excluded, k + 1), F.shiftright(low(k + 1), 8) == F.col("x_context"), "left")
        t = F.coalesce("total", F.lit(0)) - F.coalesce("out_total", F.lit(0))
        d = F.coalesce("kinds", F.lit(0)) - F.coalesce("out_kinds", F.lit(0))
        coded = F.when(F.col("k_n").isNotNull(), F.col("acc") + F.log10((2 * F.col("k_n") - 1) / (2 * t)))
        acc = F.col("acc") + F.when(d > 0, F.log10(d / (2 * t))).otherwise(F.lit(0.0))
        rest = rest.select("key", F.coalesce("value", coded).alias("value"), acc.alias("acc"))
    last = F.col("acc") - F.lit(float(np.log10(max(1, SYMBOLS - distinct_symbols))))
    return seen.unionByName(rest.select("key", F.coalesce("value", last).alias("value")))


def score_documents(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", cfg: PpmConfig | None = None) -> DataFrame:
    """Scores of every row under counts of the rows for which held_out(id) does not hold."""
    spark, cfg = df.sparkSession, cfg or PpmConfig()
    common.ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, -(-size // cfg.block_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size // cfg.least_block)))
    rows = rows.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    keys, _ = common.materialize(spark, rows.groupBy("block").applyInArrow(_summarise(cfg), "block long, key long, n long"), "ppm-keys")
    counts, count_path = common.materialize(spark, keys.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    words = counts.where((F.col("key") >= END_WORD) & (F.col("n") > 0))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    paths: list[str] = []
    values = value_grams(spark, counts.where(F.col("key") < END_WORD), cfg.order, paths).unionByName(words.select("key", F.col("n").cast("double").alias("value")))
    values, _ = common.materialize(spark, values, "ppm-values")
    for path in (*paths, count_path):
        common.remove(spark, path)
    wanted = keys.join(values, "key").where((F.col("key") < END_WORD) | (F.col("n") != F.col("value"))).select("block", "key", "value")
    out = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_score(cfg, total["n"], total["v"]), OUT)
    return out.withColumnRenamed("id", id_col)


def held_out_tenth(i):
    return F.crc32(i.cast("string").cast("binary")) % 10 == 0


def op7_ppm(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), held_out_tenth)
