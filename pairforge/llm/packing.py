"""Vector bin packing of token sequences by the dot-product heuristic.

An example has three demands: tokens, one segment, and tokens that bear loss. A sequence offers as
many of each as its limits say. The packer opens a sequence and takes, again and again, the example
that fits and whose demands have the largest dot product with what is left, both in units of the
limits. If none fits, the next best one is cut at what is left. So a sequence ends full unless the segment or loss limit binds first, and where loss binds, tokens that bear none fill the rest.

Which tokens bear loss: of instruction data (`pack_parts`) those of the parts that say so, under a limit of their own;
of plain documents all of them, so that documents have two limits that bind, tokens and segments. A configuration may
read the first `prompt` tokens of each document as context that bears none.

Each task packs its own rows as they stream by, with a bounded pool; what remains at a task's end is
laid out in sequences whose lengths are powers of two, which need no padding. No shuffle; ids of
sequences carry the partition's number. A task that is run again packs its rows again as a whole.

Defined results: null text counts as empty and has the end id alone; a null id stays null; repeated
rows are separate examples; an empty table gives no pieces; a text longer than a sequence is cut. Of parts,
null text is empty, null loss is true, and null or no parts are an example of the end id alone, which bears loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common
from pairforge.llm.bpe_reuse import load_tokenizer, tokenizer_path
from pairforge.llm.stretches import PreTokenModel, StretchStore, no_collection


@dataclass(frozen=True)
class PackConfig:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    prompt: int = 0
    pool: int = 1024
    end_id: int = 1
    store_words: int = 1_000_000


@dataclass
class Example:
    """ids: little-endian unsigned 32-bit; loss: running count of loss-bearing ids, or None: all but the first `prompt`."""

    key: int | None
    ids: bytes
    loss: np.ndarray | None = None
    prompt: int = 0

    def __len__(self) -> int:
        return len(self.ids) // 4

    def loss_between(self, a: int, b: int) -> int:
        if self.loss is None:
            return max(b, self.prompt) - max(a, self.prompt)
        return int(self.loss[b] - self.loss[a])

    def reach(self, a: int, end: int, tokens: int, loss: int) -> int:
        """The furthest place from a, up to end, within both limits."""
        b = min(end, a + tokens)
        if self.loss is None:
            return min(b, max(a, self.prompt) + loss)
        return min(b, int(np.searchsorted(self.loss, self.loss[a] + loss, "right")) - 1)


Piece = tuple[Example, int, int, int, int]  # example, start, length, sequence, offset


class Packer:
    """Takes examples one by one and yields pieces; at most cfg.pool examples, or parts of long ones, wait."""

    def __init__(self, cfg: PackConfig, first_sequence: int = 0):
        self.cfg, self.sequence = cfg, first_sequence
        self.waiting: list[tuple[Example, int, int]] = []

    def add(self, example: Example) -> Iterator[Piece]:
        """What would fill a sequence alone is cut off and waits as a part of its own."""
        at, n = 0, len(example)
        while at < n:
            end = example.reach(at, n, self.cfg.tokens, self.cfg.loss)
            self.waiting.append((example, at, end))
            at = end
            if len(self.waiting) >= self.cfg.pool:
                yield from self._pack(last=False)

    def finish(self) -> Iterator[Piece]:
        yield from self._pack(last=True)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _pack(self, last: bool) -> Iterator[Piece]:
        """The demand for a segment is one for all, so it bounds a sequence but does not tell examples apart."""
        cfg, pool = self.cfg, self.waiting
        tokens = np.array([b - a for _, a, b in pool], float)  # infinite when taken
        bears = np.array([e.loss_between(a, b) for e, a, b in pool], float)
        total, waiting = int(tokens.sum()), len(pool)
        while waiting and (total >= cfg.tokens or last):
            size = cfg.tokens if total >= cfg.tokens else 1 << (total.bit_length() - 1)
            room, segments, loss, offset, sequence = size, cfg.segments, cfg.loss, 0, self._next()
            while room >= 1 and segments >= 1 and waiting:
                value = tokens * (room / cfg.tokens**2) + bears * (loss / cfg.loss**2)
                fits = (tokens <= room) & (bears <= loss)
                k = int(np.where(fits, value, -1.0).argmax())
                if fits[k]:
                    example, a, b = pool[k]
                    used, bearing = b - a, int(bears[k])
                    tokens[k], waiting = np.inf, waiting - 1
                else:
                    k = self._best_cut(pool, tokens, value, room, loss)
                    if k < 0:
                        break
                    example, a, end = pool[k]
                    b = example.reach(a, end, room, loss)
                    used, bearing = b - a, example.loss_between(a, b)
                    pool[k] = (example, b, end)
                    tokens[k] -= used
                    bears[k] -= bearing
                room, segments, loss, total = room - used, segments - 1, loss - bearing, total - used
                yield example, a, used, sequence, offset
                offset += used
            if 2 * waiting < len(pool):
                keep = np.flatnonzero(np.isfinite(tokens))
                pool, tokens, bears = [pool[k] for k in keep.tolist()], tokens[keep], bears[keep]
        self.waiting = [pool[k] for k in np.flatnonzero(np.isfinite(tokens)).tolist()]

    @staticmethod
    def _best_cut(pool: list[tuple[Example, int, int]], tokens: np.ndarray, value: np.ndarray, room: int, loss: int) -> int:
        """The best example of which anything can be taken; without room for loss, only what begins without any."""
        value = np.where(np.isfinite(tokens), value, -1.0)
        if loss >= 1:
            return int(value.argmax())
        for k in np.argsort(-value, kind="stable").tolist():
            example, a, end = pool[k]
            if value[k] >= 0 and example.reach(a, end, room, 0) > a:
                return k
        return -1


class WordStore:
    """Ids of texts by whitespace-free stretches.

    The vocabulary's normalizer and pre-tokenizer never look across a space or a line feed, so
    a text's ids are those of its stretches in order. A stretch of letters with marks after it is
    one pre-token of letters and one of marks; where the letters are ASCII, or lower-case and
    composed already, the normalizer's work is known and the model alone is asked.
    """

    def __init__(self, path: str, cfg: PackConfig):
        self.tok = load_tokenizer(path)
        self.store = StretchStore(cfg.store_words, PreTokenModel(self.tok, "I", cfg.store_words, fold=True).learn)

    def encode(self, texts: list[str]) -> list[bytes]:
        with no_collection():
            return self.store.ids([t.replace("\n", " ").split(" ") for t in texts])


OUT = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _kernel(path: str | None, cfg: PackConfig, keep_ids: bool, parts: bool = False):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def table(pieces: list[Piece]) -> pa.RecordBatch:
        part = [(e, e.ids[4 * a : 4 * (a + n)]) for e, a, n, _, _ in pieces]
        columns = [[e.key for e, _ in part], [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(x) for _, x in part], [len(e) for e, _ in part], [p[3] for p in pieces], [p[4] for p in pieces]]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if keep_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for _, x in part], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    end = np.array([cfg.end_id], "<u4").tobytes()

    def examples(keys: list[int | None], rows: list) -> Iterator[Example]:
        store = common.WORKER[("words", path, cfg)]
        if not parts:
            yield from (Example(k, ids + end, None, cfg.prompt) for k, ids in zip(keys, store.encode(rows), strict=True))
            return
        flat = iter(store.encode([p["text"] or "" for row in rows for p in row or ()]))
        for key, row in zip(keys, rows, strict=True):
            got, bears = [next(flat) for _ in row or ()], [p["loss"] is not False for p in row or ()]
            marks = [np.full(len(x) // 4, y) for x, y in zip(got, bears, strict=True)]
            yield Example(key, b"".join([*got, end]), np.cumsum(np.concatenate([[False], *marks, [bears[-1] if bears else True]])))

    def size_of(row) -> int:
        return len(row) if not parts else sum(len(p["text"] or "") for p in row or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.worker_turn("packing")
        key = ("words", path, cfg)
        if key not in common.WORKER:
            common.WORKER[key] = WordStore(path or tokenizer_path("word_bpe_49k.json"), cfg)
        packer, pieces = Packer(cfg, TaskContext.get().partitionId() << 36), []
        for batch in batches:
            keys, texts, lo = batch.column(0).to_pylist(), batch.column(1), 0
            while lo < batch.num_rows:
                part, size = [], 0
                while lo + len(part) < batch.num_rows and (not part or size < 4_000_000):
                    part.append(texts[lo + len(part)].as_py())
                    size += size_of(part[-1])
                for example in examples(keys[lo : lo + len(part)], part):
                    pieces += packer.add(example)
                lo += len(part)
                yield table(pieces)
                pieces = []
        yield table(list(packer.finish()))

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, cfg: PackConfig | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids with their places in sequences; keep_ids adds the ids themselves."""
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return rows.mapInArrow(_kernel(path, cfg or PackConfig(), keep_ids), OUT + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)


def pack_parts(df: DataFrame, id_col: str, parts_col: str, path: str | None = None, cfg: PackConfig | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of instruction data: each row's parts are an array of {text, loss}, encoded one by one and followed
    by the end id, which bears loss if the last part does."""
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(parts_col, lambda p: F.struct(p["text"].cast("string").alias("text"), p["loss"].cast("boolean").alias("loss"))).alias("parts"))
    return rows.mapInArrow(_kernel(path, cfg or PackConfig(), keep_ids, parts=True), OUT + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
