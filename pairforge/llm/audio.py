"""Audio features: a text's bytes as 8-bit samples in a WAV file, read back and analysed.

Path of one row: payload -> WAV (8-bit PCM, mono) -> samples -> polyphase resampling ->
overlapped log-mel filterbank -> hysteresis energy segmentation -> fixed-shape Arrow tensors
with time spans. Every step works on one row alone, so the operator has no shuffle, and equal
texts give equal values whatever batch they are in.

Defined results: null text counts as empty; an empty payload is 64 zero samples; input shorter
than a frame is padded with silence to one frame; repeated rows and ids are each answered;
an empty table gives an empty result; columns beyond the id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16_000
    up: int = 5
    down: int = 8
    half_width: int = 8
    frame: int = 256
    hop: int = 100
    mels: int = 32
    tensor_frames: int = 64
    tensor_hop: int = 32
    on_db: float = 0.5
    off_db: float = -0.5
    block: int = 4096

    @property
    def new_rate(self) -> float:
        return self.rate * self.up / self.down


@dataclass
class Analysis:
    log_mel: np.ndarray
    energy_db: np.ndarray
    segments: list[tuple[float, float]] = field(default_factory=list)


def encode_wav(payload: bytes, rate: int) -> bytes:
    """Lossless 8-bit mono PCM."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", n) + payload


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and sample bytes; walks the chunks as any reader would."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pad_payload(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def polyphase_filter(cfg: AudioConfig) -> np.ndarray:
    """Windowed-sinc low-pass for up/down, one row of taps per phase."""
    widest = max(cfg.up, cfg.down)
    half = cfg.half_width * widest
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / widest) * np.hamming(2 * half + 1)
    taps *= cfg.up / taps.sum()
    per_phase = -(-taps.size // cfg.up)
    taps = np.pad(taps, (0, per_phase * cfg.up - taps.size))
    return taps.reshape(per_phase, cfg.up).T[:, ::-1].copy()


def resample(x: np.ndarray, cfg: AudioConfig, phases: np.ndarray) -> np.ndarray:
    """Rational resampling: output n takes the taps of phase n*down mod up, no zero stuffing."""
    taps = phases.shape[1]
    half = cfg.half_width * max(cfg.up, cfg.down)
    n_out = -(-x.size * cfg.up // cfg.down)
    out = np.empty(n_out)
    padded = np.pad(x, (taps, taps + cfg.down))
    for first in range(min(cfg.up, n_out)):
        pos = first * cfg.down + half
        phase, start = pos % cfg.up, pos // cfg.up
        count = -(-(n_out - first) // cfg.up)
        base = start - taps + 1 + taps
        need = base + (count - 1) * cfg.down + taps
        if need > padded.size:
            padded = np.pad(padded, (0, need - padded.size))
        windows = np.lib.stride_tricks.as_strided(padded[base:], (count, taps), (padded.strides[0] * cfg.down, padded.strides[0]))
        out[first :: cfg.up] = windows @ phases[phase]
    return out


def mel_bank(cfg: AudioConfig) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, as (bins, mels)."""
    bins = np.arange(cfg.frame // 2 + 1) * cfg.new_rate / cfg.frame
    to_mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    points = 700.0 * (10 ** (np.linspace(to_mel(60.0), to_mel(cfg.new_rate / 2), cfg.mels + 2) / 2595.0) - 1)
    rise = (bins[:, None] - points[None, :-2]) / (points[1:-1] - points[:-2])
    fall = (points[None, 2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall))


def hysteresis(energy_db: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Segments open at energy >= on and close at the first frame below off."""
    mark = np.where(energy_db >= on, 1, np.where(energy_db < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(mark.size), -1))
    active = (last >= 0) & (mark[last] == 1)
    edge = np.diff(np.concatenate(([0], active.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


class Analyzer:
    """Constants of one configuration and the analysis of one payload."""

    def __init__(self, cfg: AudioConfig):
        self.cfg, self.phases, self.bank = cfg, polyphase_filter(cfg), mel_bank(cfg)
        self.window = np.hanning(cfg.frame)

    def analyse(self, samples: bytes) -> Analysis:
        cfg = self.cfg
        x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0) / 128.0
        y = resample(x, cfg, self.phases)
        if y.size < cfg.frame:
            y = np.pad(y, (0, cfg.frame - y.size))
        n = 1 + (y.size - cfg.frame) // cfg.hop
        frames = np.lib.stride_tricks.as_strided(y, (n, cfg.frame), (y.strides[0] * cfg.hop, y.strides[0]))
        mel, energy = np.empty((n, cfg.mels), np.float32), np.empty(n)
        for a in range(0, n, cfg.block):
            part = frames[a : a + cfg.block]
            spectrum = np.fft.rfft(part * self.window)
            mel[a : a + cfg.block] = np.log(np.maximum((spectrum.real**2 + spectrum.imag**2) @ self.bank, 1e-10))
            energy[a : a + cfg.block] = 10.0 * np.log10(np.maximum((part * part).mean(1), 1e-10))
        middle = float(np.median(energy))
        at = lambda k: k * cfg.hop / cfg.new_rate
        spans = [(at(a), at(b - 1) + cfg.frame / cfg.new_rate) for a, b in hysteresis(energy, middle + cfg.on_db, middle + cfg.off_db)]
        return Analysis(mel, energy, spans)

    def tensors(self, got: Analysis) -> pa.RecordBatch:
        """Overlapping windows of frames as a fixed-shape tensor column with time spans."""
        cfg, n = self.cfg, len(got.log_mel)
        count = 1 + max(0, -(-(n - cfg.tensor_frames) // cfg.tensor_hop))
        size = (count - 1) * cfg.tensor_hop + cfg.tensor_frames
        mel = np.pad(got.log_mel, ((0, size - n), (0, 0)), constant_values=np.float32(np.log(1e-10)))
        cut = np.stack([mel[k * cfg.tensor_hop : k * cfg.tensor_hop + cfg.tensor_frames] for k in range(count)])
        start = np.arange(count) * cfg.tensor_hop * cfg.hop / cfg.new_rate
        end = start + ((cfg.tensor_frames - 1) * cfg.hop + cfg.frame) / cfg.new_rate
        return pa.record_batch({"start_s": pa.array(start), "end_s": pa.array(end), "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(cut)})


def tensors_to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


FULL = "id long, n_bytes long, media binary, segments array<struct<start_s:double,end_s:double>>, tensors binary"
DIGEST = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"


def _digest(segments: list[tuple[float, float]], stored: bytes) -> str:
    """What the stored tensors say, read back: their number, time span and mean log-mel bands; and the segments."""
    table = tensors_from_ipc(stored)
    means = ",".join(f"{v:.2f}" for v in table["log_mel"].combine_chunks().to_numpy_ndarray().mean((0, 1), dtype=np.float64))
    voiced = sum(b - a for a, b in segments)
    return f"tensors={table.num_rows};to_s={table['end_s'][-1].as_py():.4f};segments={len(segments)};voiced_s={voiced:.3f};log_mel={means}"


def _kernel(cfg: AudioConfig, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = Analyzer(cfg)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                rows = []
                for k in range(lo, min(lo + 512, batch.num_rows)):
                    data = texts[k].as_buffer()
                    data = data.to_pybytes() if data else b""
                    media = encode_wav(pad_payload(data), cfg.rate)
                    payload = decode_wav(media)[1]
                    got = analyzer.analyse(payload)
                    stored = tensors_to_ipc(analyzer.tensors(got))
                    if full:
                        rows.append((len(data), media, [{"start_s": a, "end_s": b} for a, b in got.segments], stored))
                    else:
                        rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _digest(got.segments, stored), len(got.log_mel), len(got.segments)))
                schema = _FULL_ARROW if full else _DIGEST_ARROW
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([ids[lo : lo + 512].cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


_SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_FULL_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("segments", _SPAN), ("tensors", pa.binary())])
_DIGEST_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in DIGEST.split(", ")])


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: AudioConfig | None = None, digests: bool = False) -> DataFrame:
    """Media, segments and tensors of every row, or only their digests, the feature from the tensors read back.

    Full output: id, n_bytes, media (WAV bytes), segments (time spans), tensors (an Arrow stream
    whose column log_mel has the type fixed_shape_tensor, with start_s and end_s).
    """
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    out = rows.mapInArrow(_kernel(cfg or AudioConfig(), not digests), DIGEST if digests else FULL)
    return out.withColumnRenamed("id", id_col)


def op1_audio(spark, sf_dir: str) -> DataFrame:
    return audio_features(common.table(spark, sf_dir, "documents"), digests=True)
