"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts a text where the content says so, hence the same passage is
cut alike in every document. Each chunk is encoded once per worker and kept in a bounded store;
documents are put together from chunks. A cut may fall inside a word, so every join is repaired:
a window around it is encoded anew, and widened until its first and last stretch have the very tokens that
the neighbouring chunks have there. Stretches end where the chunks' tokens do and no pre-token goes on, so
the result is exactly what encoding the whole text would give.

No shuffle: reuse is per worker. Encoding a chunk once in the whole cluster would move every
chunk's text and ids through a shuffle, more than the encoding saves.

Defined results: null text counts as empty (no ids); repeated rows are each answered; the text of
the special token encodes as the library does by default; an empty table gives an empty result;
a text without any white space is repaired by encoding it as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common
from pairforge.llm.stretches import PreTokenModel, StretchStore, no_collection


@dataclass(frozen=True)
class ChunkConfig:
    window: int = 32
    mean: int = 1024
    least: int = 256
    most: int = 16_384
    store_tokens: int = 6_000_000
    store_words: int = 600_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = ("tokenizer", path)
    if key not in common.WORKER:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        common.WORKER[key] = tok
    return common.WORKER[key]


def rolling_hash(raw: np.ndarray, window: int) -> np.ndarray:
    """Hash of the last `window` bytes (a power of two) at each position, by doubling."""
    h = common.seeds(256, 0x51)[raw]
    width = 1
    while width < window:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if width < h.size else 0
        h = h + (shifted << np.uint64(width))
        width *= 2
    return h


def cut_points(raw: np.ndarray, cfg: ChunkConfig) -> list[int]:
    """Ends of chunks, the last being the text's end; never inside a character."""
    if not raw.size:
        return []
    out, last = [], 0
    for p in (np.flatnonzero(rolling_hash(raw, cfg.window) >> np.uint64(34) < np.uint64((1 << 30) // cfg.mean)) + 1).tolist() + [raw.size]:
        while p - last > cfg.most:
            last = _character_start(raw, last + cfg.most)
            out.append(last)
        if p == raw.size or p - last >= cfg.least:
            p = _character_start(raw, p)
            if p > last:
                out.append(p)
                last = p
    return out


def _character_start(raw: np.ndarray, p: int) -> int:
    while p < raw.size and raw[p] & 0xC0 == 0x80:
        p += 1
    return p


def safe_points(raw: np.ndarray) -> np.ndarray:
    """Positions of a space between two visible ASCII characters.

    A pre-token can begin with that space but none can contain it further in, so the text's
    encoding is that of what precedes it followed by that of the rest.
    """
    seen = (raw > 32) & (raw < 127)
    return np.flatnonzero((raw[1:-1] == 32) & seen[:-2] & seen[2:]) + 1


#: White space beyond ASCII, in UTF-8.
ODD_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _visible(raw: np.ndarray) -> np.ndarray:
    return (raw > 32) & (raw != 127)


class ReusingEncoder:
    """Encodes batches of texts by stored chunks and repaired joins."""

    def __init__(self, path: str, cfg: ChunkConfig):
        self.tok, self.cfg, self.store, self.held = load_tokenizer(path), cfg, {}, 0
        self.encoded_bytes = 0
        self.first = StretchStore(cfg.store_words // 8, PreTokenModel(self.tok, "H", cfg.store_words // 8, fold=False).learn)
        self.spaced = StretchStore(cfg.store_words, PreTokenModel(self.tok, "H", cfg.store_words, fold=False, before=" ").learn)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Where every space of a text is a safe point, its ids are those of its words in order."""
        self.encoded_bytes += sum(map(len, texts))
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, words = [], []
        for k, data in enumerate(texts):
            raw = np.frombuffer(data, np.uint8)
            spaces = np.flatnonzero(raw == 32)
            if spaces.size and (spaces[0] == 0 or spaces[-1] == raw.size - 1 or not _visible(raw[spaces - 1]).all() or not _visible(raw[spaces + 1]).all() or ODD_SPACE.search(data)):
                plain.append(k)
            else:
                words.append((k, data.decode().split(" ")))
        heads = self.first.ids([w[:1] for _, w in words])
        tails = self.spaced.ids([w[1:] for _, w in words])
        for (k, _), a, b in zip(words, heads, tails, strict=True):
            out[k] = np.frombuffer(a + b, np.uint16)
        encoded = self.tok.encode_batch_fast([texts[k].decode() for k in plain], add_special_tokens=False)
        for k, e in zip(plain, encoded, strict=True):
            out[k] = np.array(e.ids, np.uint16)
        return out

    def _fetch(self, pieces: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of pieces, each encoded at most once while it stays in the store."""
        missing = [p for p in dict.fromkeys(pieces) if p not in self.store]
        if self.held > self.cfg.store_tokens:
            self.store, self.held = {p: self.store[p] for p in set(pieces) if p in self.store}, 0
            self.held = sum(v.size for v in self.store.values())
        for a in range(0, len(missing), 8192):
            part = missing[a : a + 8192]
            for p, ids in zip(part, self._encode(part), strict=True):
                self.store[p] = ids
                self.held += ids.size + 16
        return self.store

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        with no_collection():
            return self._encode_all(texts)

    def _encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        drafts = []
        for data in texts:
            raw = np.frombuffer(data, np.uint8)
            cuts = cut_points(raw, self.cfg)
            drafts.append((data, raw, cuts, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]))
        known = self._fetch([c for _, _, _, chunks in drafts for c in chunks])
        joined = [Joined(data, raw, cuts, [known[c] for c in chunks], self.width) for data, raw, cuts, chunks in drafts]
        del drafts
        pending = [j for j in joined if j.windows]
        while pending:
            known = self._fetch([j.text(w) for j in pending for w in j.windows])
            pending = [j for j in pending if not j.agree(known)]
        return [j.ids for j in joined]


class Joined:
    """Ids of a text put together from its chunks' ids, repaired at the joins.

    A window is a stretch between stops: places where no pre-token goes on and where the chunks' tokens end,
    too. It reaches one stop further from the cut than it must, so that its first and last stretch are also
    in the chunks' ids. Encoded anew, it must give the same ids there; else it is widened at that end.
    """

    def __init__(self, data: bytes, raw: np.ndarray, cuts: list[int], chunks: list[np.ndarray], width: np.ndarray):
        self.data, self.width = data, width
        self.ids = np.concatenate(chunks) if chunks else np.empty(0, np.uint16)
        self.windows: list[tuple[int, int]] = []
        if len(cuts) < 2:
            return
        self.ends = np.cumsum(width[self.ids])
        safe = safe_points(raw)
        at = np.searchsorted(self.ends, safe)
        safe = safe[(at < self.ends.size) & (self.ends[np.minimum(at, self.ends.size - 1)] == safe)]
        self.stops = np.concatenate(([0], safe, [len(data)]))
        where = np.searchsorted(self.stops, cuts[:-1]).tolist()
        self._set([(k - 2, k + 1) for k, cut in zip(where, cuts[:-1], strict=True) if self.stops[k] != cut])

    def _set(self, windows: list[tuple[int, int]]) -> None:
        """Windows in order; those that overlap become one."""
        last, self.windows = self.stops.size - 1, []
        for i, j in windows:
            i, j = max(0, i), min(last, j)
            if self.windows and i < self.windows[-1][1]:
                i, j = self.windows[-1][0], max(j, self.windows.pop()[1])
            self.windows.append((i, j))

    def text(self, window: tuple[int, int]) -> bytes:
        return self.data[self.stops[window[0]] : self.stops[window[1]]]

    def agree(self, known: dict[bytes, np.ndarray]) -> bool:
        """Put the windows' ids in place if all agree with the chunks; else widen those that do not."""
        wider, last = [], self.stops.size - 1
        fresh = [known[self.text(w)] for w in self.windows]
        for (i, j), ids in zip(self.windows, fresh, strict=True):
            ends = self.stops[i] + np.cumsum(self.width[ids])
            left = i == 0 or self._same(i, i + 1, ids, ends)
            right = j == last or self._same(j - 1, j, ids, ends)
            wider.append((i if left else i - 2, j if right else j + 2))
        if wider != self.windows:
            self._set(wider)
            return False
        out, at = [], 0
        for (i, j), ids in zip(self.windows, fresh, strict=True):
            out += [self.ids[at : np.searchsorted(self.ends, self.stops[i], "right")], ids]
            at = int(np.searchsorted(self.ends, self.stops[j], "right"))
        self.ids = np.concatenate([*out, self.ids[at:]])
        return True

    def _same(self, i: int, j: int, ids: np.ndarray, ends: np.ndarray) -> bool:
        """Whether both have the same tokens from stop i to stop j."""
        bounds = self.stops[[i, j]]
        a, b = np.searchsorted(self.ends, bounds, "right")
        c, d = np.searchsorted(ends, bounds, "right")
        return b - a == d - c and (c == 0 or ends[c - 1] == bounds[0]) and d > 0 and ends[d - 1] == bounds[1] and bool((self.ids[a:b] == ids[c:d]).all())


FULL = "id long, ids array<int>, decoded string"
DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _kernel(path: str | None, cfg: ChunkConfig, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("bpe")
        key = ("encoder", path, cfg)
        if key not in common.WORKER:
            common.WORKER[key] = ReusingEncoder(path or tokenizer_path("byte_bpe_50k.json"), cfg)
        encoder = common.WORKER[key]
        names = common.WORKER.setdefault("digits", [str(i) for i in range(encoder.width.size)])
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                part, size, hi = [], 0, lo
                while hi < batch.num_rows and (not part or size < 4_000_000):
                    part.append(texts[hi].as_py().encode())
                    size += len(part[-1])
                    hi += 1
                got = [x.tolist() for x in encoder.encode(part)]
                decoded = encoder.tok.decode_batch(got, skip_special_tokens=False)
                if full:
                    yield pa.record_batch([ids[lo:hi], pa.array(got, pa.list_(pa.int32())), pa.array(decoded)], names=["id", "ids", "decoded"])
                else:
                    sha = [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in got]
                    text = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                    yield pa.record_batch([ids[lo:hi], pa.array([len(x) for x in got], pa.int64()), pa.array(sha), pa.array(text)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                lo = hi

    return run


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, cfg: ChunkConfig | None = None, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every row, or their digests (same computation)."""
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return rows.mapInArrow(_kernel(path, cfg or ChunkConfig(), not digests), DIGEST if digests else FULL).withColumnRenamed("id", id_col)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_round_trip(common.table(spark, sf_dir, "documents"), digests=True)
