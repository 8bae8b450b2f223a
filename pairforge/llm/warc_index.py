"""WARC archives of pages and their capture index by external merge.

1. Pages with equal payloads are told apart by an aggregate over digests: the smallest page_id is
   written as a response, the others as revisits of it. Payloads that a 4,096th of all pages share are
   broadcast, at most 4,096 digests; pages of others meet their digest in a shuffle.
2. Writers put records into gzip-per-record archives in the shared folder.
3. Indexers read the archives back, check every payload against its digest, and write a run of
   captures sorted by URL key and timestamp, beside the archive.
4. Runs are merged by a loser tree. Where there are more runs than the fan-in, groups of them are
   merged into longer runs first. Every merge is split into ranges of (key, timestamp, id), so
   a single URL with many captures is spread over ranges too, and a longer run is a list of files.
   Memory is one batch per run.

Every step's result is a small table in the shared folder that names files; a file of an attempt
that failed is named nowhere. Archives and runs stay in the folder: the result is read from them.

Pages have no time of capture, so the archives' is `first_capture` and page_id seconds.

Defined results: null html counts as empty, a null url has an empty key and sorts first, a null
page_id sorts last in its key and is never referred to while its payload has a row with an id;
rows that share payload and smallest id are all responses; an empty table gives no captures.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class WarcConfig:
    min_bytes: int = 0
    archive_bytes: int = 64 << 20
    archive_records: int = 100_000
    level: int = 1
    fan_in: int = 512
    #: Rows of a batch of a run; a merge holds one of each run, 83 MB as Python rows at the full fan-in.
    batch: int = 256
    sample: int = 4096
    first_capture: str = "2020-01-01T00:00:00"


HIGH = 0x70616972666F8267
NO_ID = 0x70616972666F8268
#: A digest that more than one page in HOT has is broadcast: there are fewer than HOT of them.
HOT = 4096

RUN = pa.schema([("surt", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
MERGED = "surt string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, range long, ordinal long"


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def surt(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; no scheme, no fragment."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    host = re.split(r"[/?]", rest, maxsplit=1)[0]
    tail = rest[len(host) :] or "/"
    name, _, port = host.lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + tail


def record_id(page_id: int | None, serial: int = 0) -> str:
    high, low = (NO_ID, serial) if page_id is None else (HIGH, page_id & 0xFFFFFFFFFFFFFFFF)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(urn: str | None) -> int | None:
    if not urn:
        return None
    number = uuid.UUID(urn[10:-1]).int
    low = number & 0xFFFFFFFFFFFFFFFF
    return None if number >> 64 != HIGH else low - (1 << 64) if low >> 63 else low


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, serial: int) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, serial)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP head and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def read_members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    at, pending, box, parts, used = 0, b"", None, [], 0
    while True:
        if not pending:
            pending = bytes(stream.read(size))
            if not pending:
                break
        box = box or zlib.decompressobj(31)
        parts.append(box.decompress(pending))
        rest = box.unused_data
        used += len(pending) - len(rest)
        pending = rest
        if box.eof:
            yield at, used, b"".join(parts)
            at, used, parts, box = at + used, 0, [], None
    if parts:
        raise ValueError("archive ends inside a record")


def _write(cfg: WarcConfig, folder: str):
    base = datetime.fromisoformat(cfg.first_capture).replace(tzinfo=timezone.utc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        done, out, name, raw, count, at, serial = [], None, "", 0, 0, 0, uuid.uuid4().int & 0xFFFFFFFFFFFF
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    name, raw, count, at = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, first = (batch.column(c)[k].as_py() for c in range(4))
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers = first if first is not None and first != page_id and len(payload) >= cfg.min_bytes else None
                seconds = (page_id or 0) % (1 << 31)
                date = (base + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
                serial += 1
                box = zlib.compressobj(cfg.level, zlib.DEFLATED, 31)
                data = box.compress(build_record(page_id, url, payload, digest, refers, date, serial)) + box.flush()
                out.write(data)
                raw, count, at = raw + len(payload), count + 1, at + len(data)
                if raw >= cfg.archive_bytes or count >= cfg.archive_records:
                    out.close()
                    done.append((name, count, at))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, at))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, cfg: WarcConfig) -> DataFrame:
    """Write (page_id, url, html) as archives; returns the table of archives (name, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.whole_text("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    firsts, path = common.materialize(spark, rows.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    often = F.col("n") * HOT > pages.count()
    hot = F.broadcast(firsts.where(often).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
    rows = rows.join(hot, "digest", "left")
    own = F.when(F.col("hot"), F.unhex(F.sha1(F.concat_ws(" ", F.lit("hot"), "page_id", "url").cast("binary")))).otherwise(F.col("digest"))
    rows = rows.withColumn("digest", own).join(firsts.where(~often).select("digest", "first"), "digest", "left")
    joined = rows.select("page_id", "url", "payload", F.coalesce("hot_first", "first").alias("first"))
    written, _ = common.materialize(spark, joined.mapInArrow(_write(cfg, folder), "archive string, records long, bytes long"), "archives")
    common.remove(spark, path)
    return written


def _key(surt_key: str, timestamp: str, page_id: int | None) -> tuple:
    return surt_key, timestamp, page_id is None, page_id or 0


def _save_run(fs, path: str, batches: Iterator[pa.RecordBatch]) -> None:
    with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, RUN) as out:
        for batch in batches:
            out.write_batch(batch)


def index_archive(fs, root: str, name: str) -> list[tuple]:
    """All captures of an archive, read back and checked, in the order of their keys."""
    rows = []
    with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
        for offset, length, data in read_members(stream):
            headers, http, payload = parse_record(data)
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = headers["WARC-Type"]
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if kind == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                    raise ValueError(f"{name} at {offset}: payload does not match its digest")
            rows.append((surt(headers.get("WARC-Target-URI")), headers["WARC-Date"], page_of(headers["WARC-Record-ID"]), size, digest, kind, page_of(headers.get("WARC-Refers-To")), name, offset, length))
    return sorted(rows, key=lambda r: _key(*r[:3]))


def _batches(rows: Iterator[tuple], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _index(cfg: WarcConfig, folder: str, keys_per_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = index_archive(fs, root, name)
                path = f"{uuid.uuid4().hex}.run"
                _save_run(fs, f"{root}/{path}", _batches(iter(rows), cfg.batch, RUN))
                step = max(1, len(rows) // keys_per_run)
                keys = [{"surt": r[0], "timestamp": r[1], "page_id": r[2]} for r in rows[step // 2 :: step][:keys_per_run]]
                yield pa.record_batch([pa.array([[path]]), pa.array([keys], _KEYS)], names=["run", "keys"])

    return run


_KEYS = pa.list_(pa.struct([("surt", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64())]))
_RUNS = "run array<string>, keys array<struct<surt:string,timestamp:string,page_id:long>>"
_BOUND = "struct<surt:string,timestamp:string,page_id:long>"


class Cursor:
    """Rows of a run from the first key above `low`, batch by batch. A run's files are in order."""

    def __init__(self, fs, root: str, files: list[str], low: tuple | None):
        self.fs, self.paths = fs, [f"{root}/{f}" for f in files]
        self.file, self.reader, self.next_batch, self.batches = -1, None, 0, 0
        self.rows, self.at = [], 0
        self.key: tuple | None = None
        self.row: tuple = ()
        if low is not None:
            self._open(max(0, self._first_above(len(self.paths), lambda k: self._head(k), low) - 1))
            if self.reader is not None:
                self.next_batch = max(0, self._first_above(self.batches, lambda k: self._key_of(self.reader.get_batch(k)), low) - 1)
        self.advance()
        while low is not None and self.key is not None and self.key <= low:
            self.advance()

    @staticmethod
    def _first_above(n: int, key, low: tuple) -> int:
        """How many of n parts in order begin at or below low."""
        a, b = 0, n
        while a < b:
            mid = (a + b) // 2
            if key(mid) <= low:
                a = mid + 1
            else:
                b = mid
        return a

    @staticmethod
    def _key_of(batch: pa.RecordBatch) -> tuple:
        return _key(*(batch.column(c)[0].as_py() for c in range(3)))

    def _head(self, file: int) -> tuple:
        with self.fs.open_input_file(self.paths[file]) as source:
            return self._key_of(pa.ipc.open_file(source).get_batch(0))

    def _open(self, file: int) -> None:
        if self.reader is not None:
            self.source.close()
        self.file, self.reader, self.next_batch, self.batches = file, None, 0, 0
        if file < len(self.paths):
            self.source = self.fs.open_input_file(self.paths[file])
            self.reader = pa.ipc.open_file(self.source)
            self.batches = self.reader.num_record_batches

    def advance(self) -> None:
        if self.at >= len(self.rows):
            while self.next_batch >= self.batches:
                self._open(self.file + 1)
                if self.reader is None:
                    self.key, self.rows, self.at = None, [], 0
                    return
            self.rows = list(zip(*(c.to_pylist() for c in self.reader.get_batch(self.next_batch).columns), strict=True))
            self.next_batch, self.at = self.next_batch + 1, 0
        self.row = self.rows[self.at]
        self.key = _key(*self.row[:3])
        self.at += 1


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, the overall winner sits on top.

    Replacing the winner replays only the matches on its path, log2(k) comparisons a row.
    """

    def __init__(self, cursors: list[Cursor]):
        self.cursors, self.k = cursors, len(cursors)
        self.loser = [-1] * max(1, self.k)
        self.winner = -1
        for leaf in range(self.k):
            self._replay(leaf, filling=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.cursors[a].key, self.cursors[b].key
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _replay(self, leaf: int, filling: bool = False) -> None:
        best, node = leaf, (leaf + self.k) // 2
        while node >= 1:
            other = self.loser[node]
            if other < 0 and filling:
                self.loser[node] = best
                return
            if self._less(other, best):
                self.loser[node], best = best, other
            node //= 2
        self.winner = best

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            top = self.cursors[self.winner]
            if top.key is None:
                return
            yield top.row
            top.advance()
            self._replay(self.winner)


def merge_runs(fs, root: str, runs: list[list[str]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of all runs with low < key <= high, in order."""
    tree = LoserTree([Cursor(fs, root, r, low) for r in runs])
    for row in tree:
        if high is not None and _key(*row[:3]) > high:
            return
        yield row


def _unpack(k: dict | None) -> tuple | None:
    return k and _key(k["surt"], k["timestamp"], k["page_id"])


def _merge_group(cfg: WarcConfig, folder: str):
    """One file of a longer run: a group's rows in one range; no file where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for g, k, runs, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _batches(merge_runs(fs, root, runs, _unpack(low), _unpack(high)), cfg.batch, RUN)
                first, path = next(found, None), f"{uuid.uuid4().hex}.run"
                if first is not None:
                    _save_run(fs, f"{root}/{path}", itertools.chain([first], found))
                yield pa.record_batch([pa.array([g], pa.int64()), pa.array([k], pa.int64()), pa.array([path if first is not None else None], pa.string())], names=["g", "k", "file"])

    return run


def _merge_ranges(cfg: WarcConfig, folder: str, runs: list[list[str]]):
    schema = RUN.append(pa.field("range", pa.int64())).append(pa.field("ordinal", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for number, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = ((*row, number, k) for k, row in enumerate(merge_runs(fs, root, runs, _unpack(low), _unpack(high))))
                yield from _batches(rows, cfg.batch, schema)

    return run


def _merge_pass(spark: SparkSession, runs: DataFrame, groups: int, folder: str, cfg: WarcConfig) -> DataFrame:
    """Runs merged into one for each group; every group in ranges of its own, so that all tasks have a share."""
    per_group = max(1, -(-common.shuffle_partitions(spark) // groups))
    held = runs.withColumn("g", F.pmod(F.xxhash64(F.element_at("run", 1)), F.lit(groups)).cast("long")).groupBy("g").agg(F.collect_list("run").alias("runs"), F.flatten(F.collect_list("keys")).alias("keys"))
    ordered = F.array_sort("keys", lambda x, y: _compare(x, y))
    bound = lambda k: F.try_element_at("keys", (F.lit(1) + F.floor(k * F.size("keys") / per_group)).cast("int"))
    tasks = held.withColumn("keys", ordered).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1)))).withColumn("k", F.col("k").cast("long"))
    low, high = F.when(F.col("k") > 0, bound(F.col("k"))), F.when(F.col("k") < per_group - 1, bound(F.col("k") + 1))
    tasks = tasks.select("g", "k", "runs", low.alias("low"), high.alias("high"))
    files, file_path = common.materialize(spark, tasks.repartition(groups * per_group, "g", "k").mapInArrow(_merge_group(cfg, folder), "g long, k long, file string"), "run-files")
    run = F.transform(F.array_sort(F.collect_list(F.struct("k", "file"))), lambda f: f["file"])
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / max(1, cfg.sample // cfg.fan_in)))
    sample = F.filter(ordered, lambda _, i: i % step == 0)
    out, _ = common.materialize(spark, files.where("file IS NOT NULL").groupBy("g").agg(run.alias("run")).join(held.select("g", sample.alias("keys")), "g").select("run", "keys"), "runs")
    common.remove(spark, file_path)
    return out


def _compare(x, y):
    """The order of _key on columns: no id comes last."""
    a = [x["surt"], x["timestamp"], x["page_id"].isNull(), F.coalesce(x["page_id"], F.lit(0))]
    b = [y["surt"], y["timestamp"], y["page_id"].isNull(), F.coalesce(y["page_id"], F.lit(0))]
    out = F.lit(0)
    for p, q in reversed(list(zip(a, b, strict=True))):
        out = F.when(p < q, F.lit(-1)).when(p > q, F.lit(1)).otherwise(out)
    return out


def merge_index(spark: SparkSession, runs: DataFrame, folder: str, cfg: WarcConfig) -> DataFrame:
    """Globally ordered captures: order by (range, ordinal)."""
    count = runs.count()
    while count > cfg.fan_in:
        runs = _merge_pass(spark, runs, -(-count // cfg.fan_in), folder, cfg)
        count = runs.count()
    held = runs.collect()  # at most fan_in rows and, over all of them, about cfg.sample keys
    keys = sorted({_unpack(k) for r in held for k in r["keys"]})
    parts = min(common.shuffle_partitions(spark), len(keys) + 1)
    bounds = [keys[i * len(keys) // parts] for i in range(1, parts)]
    struct = [None if b is None else (b[0], b[1], None if b[2] else b[3]) for b in [None, *bounds, None]]
    ranges = spark.createDataFrame([(i, struct[i], struct[i + 1]) for i in range(len(struct) - 1)], f"range long, low {_BOUND}, high {_BOUND}")
    return ranges.repartition(len(struct) - 1).mapInArrow(_merge_ranges(cfg, folder, [r["run"] for r in held]), MERGED)


def archive_and_index(pages: DataFrame, cfg: WarcConfig | None = None, folder: str | None = None) -> DataFrame:
    """Write archives, read them back, and return the globally ordered capture history."""
    spark, cfg = pages.sparkSession, cfg or WarcConfig()
    common.ship(spark)
    folder = folder or common.scratch(spark, "warc")
    archives = write_archives(pages, folder, cfg)
    n = max(1, archives.count())
    per_run = max(1, cfg.sample // n)
    indexed = archives.select("archive").repartition(n).mapInArrow(_index(cfg, folder, per_run), _RUNS)
    runs, _ = common.materialize(spark, indexed, "runs")
    return merge_index(spark, runs, folder, cfg)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """What the merged index says of every page; archive_and_index also has keys, places and order."""
    out = archive_and_index(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_NIBBLE = "(instr('0123456789abcdef', substr(x, 5 * g + {k}, 1)) - 1)"
_TWENTY_BITS = "(" + " + ".join(f"{16 ** (5 - k)} * {_NIBBLE.format(k=k)}" for k in range(1, 6)) + ")"
_FOUR_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_TWENTY_BITS} // {1 << shift}) % 32) + 1, 1)" for shift in (15, 10, 5, 0))

ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_FOUR_DIGITS}), '') AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
