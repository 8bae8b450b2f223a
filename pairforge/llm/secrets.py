"""Secret scan with a recursive decoding worklist.

The whole text is scanned for three kinds of secret. Then a worklist unwraps what may hide more:
URL escapes, Unicode escapes, base64 runs (also over several lines, or glued to other characters of their
alphabet) and compressed payloads of one or more members inside them, between whose escapes plain
characters may stand. Each unwrapping
replaces the encoded stretch in place and gives a new layer; a layer is scanned, put on the
worklist, and dropped if it has been seen before (cycles) until nothing new comes. Every character
of a layer knows the span of the original text that it came from, so a finding in any layer is
reported in the coordinates of the original text.

Each row is judged alone: no shuffle. A cheap search over a batch picks the rows that need the
exact patterns.

Defined results: null text counts as empty; rows repeat as they come; bytes that are not valid text are
left alone in URL escapes, replaced in payloads, and base64 that has any and is no payload is left alone; a layer may be
at most `max_growth` times the text plus `max_extra` characters: what would be larger becomes several
layers, and a larger payload is streamed to its end in windows. Windows are cut where no encoded run and no secret is
open, so that what lies in one is whole; only a run of over `max_run` bytes inside a streamed payload is cut, with an overlap. A guard
against decompression bombs inside bombs ends a payload, and it alone, after `max_stream` bytes of its own; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_16 = re.compile(r"[0-9a-f]{16,}")

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
BASE64_LINE = re.compile(r"([A-Za-z0-9+/_-]+)=*")
STANDARD = str.maketrans("-_", "+/")
READABLE = re.compile(rb"[\t\n\r -~]{16,}")
COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: Beginnings of gzip, zlib, bzip2 and xz with at least one escape, and a byte of the rest, escaped or not.
URL_PAYLOAD = re.compile(r"(?i:%1f%8b|%78(?:%01|%5e|\^|%9c|%da)|x(?:%01|%5e|%9c|%da)|(?:B|%42)(?:Z|%5a)(?:h|%68)(?=[1-9%])|%fd(?:7|%37)(?:z|%7a))")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|([!-$&-~])")
UNICODE_PAYLOAD = re.compile(r"(?i:(?:\\x|\\u00|\\u\{0*)1f\}?(?:\\x|\\u00|\\u\{0*)8b|(?:x|(?:\\x|\\u00|\\u\{0*)78\}?)(?:\^|(?:\\x|\\u00|\\u\{0*)(?:01|5e|9c|da))|(?:B|(?:\\x|\\u00|\\u\{0*)42\}?)(?:Z|(?:\\x|\\u00|\\u\{0*)5a\}?)(?:h|(?:\\x|\\u00|\\u\{0*)68\}?)(?=[1-9\\])|(?:\\x|\\u00|\\u\{0*)fd)")
UNICODE_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,2})\}|\\([abfnrtv0'\"\\])|([ -\[\]-~])")
SINGLE = dict(zip("abfnrtv0'\"\\", b"\a\b\f\n\r\t\v\0'\"\\", strict=True))

#: For a whole batch: which rows can match at all. Never narrower than the exact patterns.
MAY_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=]"""
MAY_HEX = r"[0-9a-f]{16}"
MAY_ESCAPE = r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f{]"
MAY_BASE64 = r"[A-Za-z0-9+/_-]{16}"


@dataclass(frozen=True)
class ScanConfig:
    max_growth: int = 16
    max_extra: int = 1 << 20
    max_stream: int = 1 << 35
    max_run: int = 1 << 26
    window: int = 1 << 20
    overlap: int = 1 << 13


Span = tuple[str, int, int]


@dataclass
class Layer:
    """Text with, for each character, its span in the original text (None: the original itself)."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is not None:
            return self.start, self.end
        at = np.arange(len(self.text), dtype=np.int64)
        return at, at + 1


def scan(text: str) -> list[Span]:
    """Findings of the three kinds, leftmost and not overlapping within a kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in HEX_16.finditer(text)]


@dataclass
class Decoded:
    """Characters with their places in the encoded text; a payload too large for a layer comes as windows."""

    at: int
    to: int
    text: str
    start: np.ndarray
    end: np.ndarray
    windows: Iterator[str] | None = None


class Budget:
    """What a text's layers may hold; larger payloads are streamed."""

    def __init__(self, cfg: ScanConfig, most: int):
        self.cfg, self.most = cfg, most


def _by_character(data: bytes, at) -> tuple[str, list[int], list[int]] | None:
    """Characters of data with the encoded positions of their first and last bytes."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    starts, ends, k = [], [], 0
    for ch in text:
        n = len(ch.encode())
        starts.append(at(k))
        ends.append(at(k + n))
        k += n
    return text, starts, ends


def _url(text: str, budget: Budget) -> Iterator[Decoded]:
    for m in URL_RUN.finditer(text):
        data, k = bytes.fromhex(m[0].replace("%", "")), 0
        while k < len(data):
            try:
                data[k:].decode()
                end = bad = len(data)
            except UnicodeDecodeError as e:
                end, bad = k + e.start, k + e.end
            if end > k:
                a = m.start() + 3 * k
                chars, starts, ends = _by_character(data[k:end], lambda j: 3 * j)
                yield Decoded(a, a + 3 * (end - k), chars, np.array(starts) + a, np.array(ends) + a)
            k = bad


def _unicode(text: str, budget: Budget) -> Iterator[Decoded]:
    for m in UNICODE_RUN.finditer(text):
        units, out = [(u.start(), u.end(), int(u[1] or u[2] or u[3], 16)) for u in UNICODE_ONE.finditer(m[0])], []
        k = 0
        while k < len(units):
            a, b, code = units[k]
            if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][2] < 0xE000:
                code, b, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][2] - 0xDC00, units[k + 1][1], k + 1
            out.append((a, b, "\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)))
            k += 1
        starts, ends, chars = zip(*out, strict=True)
        yield Decoded(m.start(), m.end(), "".join(chars), np.array(starts) + m.start(), np.array(ends) + m.start())


FAULTS = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)


def _box(data: bytes):
    """A decompressor if data begins like gzip, zlib, bzip2 or xz."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=1 << 26) if data[:6] == b"\xfd7zXZ\0" else None


def inflate(data: bytes, most: int) -> tuple[bytes, int] | None:
    """What all whole members at the beginning of data hold, and the bytes they took; more than `most` bytes
    of it: the payload is larger."""
    parts, size, used, view = [], 0, 0, memoryview(data)
    while used < len(data) and (box := _box(bytes(view[used : used + 6]))):
        at, member = used, []
        try:
            while not box.eof and at < len(data):
                chunk = view[at : at + (1 << 16)]
                member.append(box.decompress(chunk, most - size + 1))
                at, size = at + len(chunk), size + len(member[-1])
                if size > most:
                    return b"".join(parts + member), len(data)
        except FAULTS:
            break
        if not box.eof:
            break
        parts, used = parts + member, at - len(box.unused_data)
    return (b"".join(parts), used) if used else None


def _pieces(data: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The payload of data, member by member, in pieces of at most `size` bytes, as far as it can be read."""
    head: bytes | None = b""
    try:
        while True:
            while len(head) < 6 and (more := next(data, None)) is not None:
                head += more
            box = _box(head)
            while box and not box.eof and head is not None:
                out = box.decompress(head, size)
                rest = getattr(box, "unconsumed_tail", b"")
                if out:
                    yield out
                head = rest if rest or out or not getattr(box, "needs_input", True) else next(data, None)
            if not box or not box.eof:
                return
            head = box.unused_data
    except FAULTS:
        return


#: Where bytes can be cut: before a control character or one beyond ASCII, after an empty line, and after a line whose last
#: character is not of base64. No encoded run and no secret goes over any of these.
HARD_CUT = re.compile(rb"(?=[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xc0-\xff])|(?<=\n)[ \t]*\r?\n|(?<=[^A-Za-z0-9+/_=\s-])[ \t]*\r?\n")
#: Before a blank between two words; only where there is no backslash, as bytes in Unicode escapes may have blanks between them.
SOFT_CUT = re.compile(rb"(?<=\S)(?= \S)")


def _cut(data: bytearray, after: int) -> int:
    """The last place beyond `after` where data can be cut, or 0."""
    patterns = (HARD_CUT,) if b"\\" in data else (SOFT_CUT, HARD_CUT)
    for size in (1 << 12, 1 << 16, len(data)):
        for pattern in patterns:
            places = [m.end() for m in pattern.finditer(data, max(after, len(data) - size)) if m.end() > after]
            if places:
                return places[-1]
    return 0


def _windows(data: bytes, depth: int, cfg: ScanConfig) -> Iterator[str]:
    """Texts of a payload that is compressed `depth` times over, to its end; each repeats the last characters of the one before."""
    stream: Iterator[bytes] = iter([data])
    for _ in range(depth):
        stream = _pieces(stream, cfg.window)
    held, done, tried, left = bytearray(), 0, 0, cfg.max_stream
    for piece in stream:
        held += piece
        left -= len(piece)
        if len(held) - done < cfg.window:
            continue
        cut = _cut(held, max(done, tried - 256)) or (len(held) if len(held) >= cfg.max_run else 0)
        tried = len(held)
        if cut:
            yield held[:cut].decode("utf-8", "replace")
            done = min(cut, cfg.overlap)
            del held[: cut - done]
            tried = 0
        if left <= 0:
            break
    if len(held) > done:
        yield held.decode("utf-8", "replace")


def _payload(data: bytes, budget: Budget) -> tuple[str, Iterator[str] | None, int] | None:
    """The text of compressed data, or its windows, and the bytes it took.

    Data that inflates to itself, at once or by a detour, is unwrapped once.
    """
    got = inflate(data, budget.most)
    if got is None:
        return None
    (inner, used), depth, seen = got, 1, {_digest(data[: got[1]])}
    while len(inner) <= budget.most and (key := _digest(inner)) not in seen and (deeper := inflate(inner, budget.most)) is not None:
        seen.add(key)
        inner, depth = deeper[0], depth + 1
    if len(inner) <= budget.most:
        return inner.decode("utf-8", "replace"), None, used
    # What is too large may be compressed itself: its beginning tells, level by level, until one is seen again.
    while (inner := next(_pieces(iter([inner]), 1 << 12), b"")) and (key := _digest(inner)) not in seen:
        seen.add(key)
        depth += 1
    return "", _windows(data[:used], depth, budget.cfg), used


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _whole(a: int, b: int, text: str, windows: Iterator[str] | None = None) -> Decoded:
    return Decoded(a, b, text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), windows)


def _mixed(text: str, budget: Budget, begin: re.Pattern, unit: re.Pattern) -> Iterator[Decoded]:
    """Payloads whose bytes are escaped where they are not printable. A run's bytes are read once for all its beginnings."""
    at, k, data, ends, index = 0, 0, bytearray(), [], {}
    while m := begin.search(text, at):
        if m.start() not in index:
            k, data, ends, index = m.start(), bytearray(), [], {}
        first, size, got = index.get(m.start(), 0), 64, None
        while True:
            while len(data) < first + size and (u := unit.match(text, k)):
                raw = u[u.lastindex]
                index[k], k = len(data), u.end()
                data.append(ord(raw) if u.lastindex == unit.groups else SINGLE[raw] if u.lastindex == 3 else int(raw, 16))
                ends.append(k)
            part = bytes(data[first : first + size])
            box = _box(part)
            try:
                out = box.decompress(part, 1 << 16) if box else None
            except FAULTS:
                out = None
            if out is None or len(part) < size or box.eof:
                got = _payload(part, budget) if out is not None else None
                break
            size *= 4
        if got:
            at = ends[first + got[2] - 1]
            yield _whole(m.start(), at, got[0], got[1])
        else:
            at = m.start() + 1


def _base64_one(text: str, lines: list[tuple[int, int]], budget: Budget) -> Decoded | None:
    """The text of base64 lines, as one."""
    run = "".join(text[a:b] for a, b in lines)
    body = run.rstrip("=")
    if len(body) % 4 == 1 or (len(run) - len(body)) not in (0, -len(body) % 4):
        return None
    try:
        data = base64.b64decode(body.translate(STANDARD) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    a, b = lines[0][0], lines[-1][1]
    if (inner := _payload(data, budget)) is not None:
        return _whole(a, b, inner[0], inner[1])
    place = np.concatenate([*(np.arange(*x) for x in lines), [b]])
    got = _by_character(data, lambda k: min(len(run), (4 * k + 2) // 3))
    return got and Decoded(a, b, got[0], place[got[1]], place[got[2]])


def _base64(text: str, budget: Budget) -> Iterator[Decoded]:
    """Wrapped lines have one length but for the last; what does not decode together is tried line by line."""
    for m in BASE64_RUN.finditer(text):
        lines, k = [(x.start(), x.end()) for x in BASE64_LINE.finditer(text, m.start(), m.end())], 0
        while k < len(lines):
            size, to = lines[k][1] - lines[k][0], k + 1
            while to < len(lines) and lines[to][1] - lines[to][0] == size:
                to += 1
            ends = [to + 1] if to < len(lines) and lines[to][1] - lines[to][0] < size else []
            for end in (*ends, *([to] if to > k + 1 or not ends else []), k + 1):
                if got := _base64_one(text, lines[k:end], budget):
                    yield got
                    break
            k = end


def _glued(shift: int):
    """Base64 that other characters of its alphabet precede or follow, such as a word and an underscore.

    A run is decoded from its `shift`-th character on; what can be read in that, or inflated, is taken, wherever it
    begins. One of four shifts meets the encoder's. Stretches too short for any secret are left.
    """

    def decode(text: str, budget: Budget) -> Iterator[Decoded]:
        for m in BASE64_RUN.finditer(text):
            lines = [x.span(1) for x in BASE64_LINE.finditer(text, m.start(), m.end())]
            run = "".join(text[a:b] for a, b in lines)[shift:]
            run = run[: len(run) - (len(run) % 4 == 1)]
            data = base64.b64decode(run.translate(STANDARD) + "=" * (-len(run) % 4))
            if not shift and _is_text(data):
                continue
            place = np.concatenate([*(np.arange(*x) for x in lines), [lines[-1][1]]])[shift:]
            char = lambda k, place=place, n=len(run): place[np.minimum(n, (4 * k + 2) // 3)]
            found, at = [], 0
            # What a single run of whole groups holds from its first character on has been read by _base64.
            known = not shift and len(lines) == 1 and len(run) == lines[0][1] - lines[0][0]
            for x in COMPRESSED.finditer(data, int(known)):
                if x.start() >= at and (got := _payload(data[x.start() :], budget)):
                    at = x.start() + got[2]
                    found.append((x.start(), at, got))
            for x in READABLE.finditer(data):
                if not any(a < x.end() and x.start() < b for a, b, _ in found):
                    found.append((x.start(), x.end(), None))
            for a, b, got in sorted(found, key=lambda f: f[0]):
                if got:
                    yield _whole(int(char(a)), int(char(b)), got[0], got[1])
                else:
                    k = np.arange(a, b)
                    yield Decoded(int(char(a)), int(char(b)), data[a:b].decode(), char(k), char(k + 1))

    return decode


def _is_text(data: bytes) -> bool:
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


def _url_payload(text: str, budget: Budget) -> Iterator[Decoded]:
    return _mixed(text, budget, URL_PAYLOAD, URL_BYTE)


def _unicode_payload(text: str, budget: Budget) -> Iterator[Decoded]:
    return _mixed(text, budget, UNICODE_PAYLOAD, UNICODE_BYTE)


DECODERS = (_url, _unicode, _base64, _url_payload, _unicode_payload, *(_glued(k) for k in range(4)))


def unwrap(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """New layers for each kind of encoding that the layer holds: one, or several where it would be too large."""
    for decode in DECODERS:
        parts, starts, ends, at, size = [], [], [], 0, 0
        marks = None
        for got in decode(layer.text, budget):
            s, e = marks = marks or layer.marks()
            if got.windows is not None:
                a, b = s[got.at : got.to].min(), e[got.at : got.to].max()
                for window in got.windows:
                    yield Layer(window, np.broadcast_to(a, len(window)), np.broadcast_to(b, len(window)))
                continue
            if parts and len(layer.text) + size + len(got.text) > budget.most:
                yield Layer("".join([*parts, layer.text[at : got.at]]), np.concatenate([*starts, s[at : got.at]]), np.concatenate([*ends, e[at : got.at]]))
                parts, starts, ends, size = [], [], [], 0
            parts += [layer.text[at : got.at], got.text]
            starts += [s[at : got.at], s[got.start]]
            ends += [e[at : got.at], e[np.maximum(got.start, got.end - 1)]]
            at, size = got.to, size + len(got.text)
        if parts:
            yield Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, s[at:]]), np.concatenate([*ends, e[at:]]))


def _order(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(text: str, cfg: ScanConfig, base: list[Span] | None = None, hidden: bool = True) -> tuple[list[Span], list[Span]]:
    """Base findings and all findings, both in the order of start, then kind."""
    base = scan(text) if base is None else base
    found = set(base)
    if hidden:
        budget = Budget(cfg, cfg.max_growth * len(text) + cfg.max_extra)
        work, seen = [unwrap(Layer(text), budget)], {_digest(text.encode("utf-8", "surrogatepass"))}
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
                continue
            key = _digest(layer.text.encode("utf-8", "surrogatepass"))
            if key not in seen:
                seen.add(key)
                found |= {(kind, *layer.span(a, b)) for kind, a, b in scan(layer.text)}
                work.append(unwrap(layer, budget))
    return _order(base), _order(found)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every finding replaced by its kind; overlapping findings become one."""
    out, at, k = [], 0, 0
    spans = sorted(spans, key=lambda x: (x[1], -x[2]))
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{kind} removed]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


def scan_batch(texts: pa.Array, cfg: ScanConfig) -> list[tuple[list[Span], list[Span]]]:
    """find_secrets of every text; exact patterns run only where a batch search says they may match."""
    may = lambda pattern: np.asarray(pc.match_substring_regex(texts, pattern))
    hidden = may(MAY_ESCAPE) | may(MAY_BASE64)
    plain = may(MAY_ASSIGN) | np.asarray(pc.match_substring(texts, "AKIA")) | may(MAY_HEX)
    return [find_secrets(t.as_py(), cfg, None if p else [], bool(h)) if p or h else ([], []) for t, p, h in zip(texts, plain, hidden, strict=True)]


def render(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


OUT = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _kernel(cfg: ScanConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("secrets")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = scan_batch(part.column(1), cfg)
                count = lambda kind: pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64())  # noqa: B023, E731
                sha = [hashlib.sha256(render(base).encode()).hexdigest() for base, _ in found]
                yield pa.record_batch([part.column(0).cast(pa.int64()), *map(count, KINDS), pa.array(sha, pa.string()), pa.array([render(s) for _, s in found], pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: ScanConfig | None = None) -> DataFrame:
    """Counts and spans of every row's secrets."""
    common.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return rows.mapInArrow(_kernel(cfg or ScanConfig()), OUT).withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None) -> DataFrame:
    """df with every finding in text_col cut out, and n_chars, if there, brought in line.

    A null text stays null. All other columns are carried as they are.
    """
    common.ship(df.sparkSession)
    cfg = cfg or ScanConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("secrets")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at = part.schema.get_field_index(text_col)
                texts = part.column(at)
                found = scan_batch(pc.fill_null(texts, ""), cfg)
                new = [redact(t.as_py(), spans) if spans else t.as_py() for t, (_, spans) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if (n := part.schema.get_field_index("n_chars")) >= 0:
                    old = part.column(n).to_pylist()
                    columns[n] = pa.array([len(t) if s else o for t, (_, s), o in zip(new, found, old, strict=True)], part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_spans(common.table(spark, sf_dir, "documents"))
