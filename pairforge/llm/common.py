"""What the operators share: the shared folder, shipping the package, text bytes and hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pairforge.shared import literal, materialize, remove, scratch, shared_dir, ship, table

__all__ = ["literal", "materialize", "remove", "scratch", "shared_dir", "ship", "table"]

#: Process-wide store of Python workers for loaded vocabularies and caches.
WORKER: dict = {}


def worker_turn(name: str) -> None:
    """Begin an operator's task in this Python worker; what another operator kept goes, its memory too.

    Workers outlive stages, so without this the stores of one operator would stand beside the next one's.
    """
    if WORKER.get("turn") != name:
        WORKER.clear()
        WORKER["turn"] = name
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64 with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on salt alone."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(salt & 0xFFFFFFFFFFFFFFFF))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of data (runs without ASCII white space), in order.

    Equal words have equal hashes. Computed without a loop over words: a prefix sum of
    byte values times powers of an odd base, divided by the power at the word's start.
    """
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(raw.size)
    total = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: raw.size], out=total[1:])
    return start, mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    return word_spans(data)[1]


_BASE = 0x2545F4914F6CDD1D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = WORKER.get("powers")
    if have is None or have[0].size < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        have = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        if size <= 1 << 22:
            WORKER["powers"] = have
    return have
