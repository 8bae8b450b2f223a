"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it occurred before.
A sketch keeps the shingles that a hash function ranks lowest, in the order of the text, so two texts
share a sketch only if they share those shingles in the same order. Texts that share any sketch are
candidates, and a banded alignment of their shingle sequences decides: m aligned shingles of n1 and n2
give similarity m / (n1 + n2 - m), and 0.8 makes a link. Classes are the components of the links.

Equal texts are one node. In a bucket (the nodes of one sketch) a node is compared with the bucket's
leader, not with all others. Buckets that still hold several components are compared in full where they
are small; where they are large, their nodes are compared with the reference of the bucket, the best known
node of its largest component, and what is left is told apart by shingles: see `_split`. A link that is
not tried joins nodes that are in one class already, so none between classes is lost, and large groups of
copies cost a comparison or two a copy. All tables live in the shared folder; leaders, links and
components are joined and aggregated, never collected.

Short and long texts have sketches of their own (`short_keep` of the lowest, `keep` of the lowest); texts
between `long_from` and `short_to` shingles have both, so any two texts that can reach 0.8 share a kind.

Defined results: null text counts as empty; equal texts are always in one class, also without words;
a text of fewer than five words is one shingle; a class is named by its smallest id, null if it has
none; repeated rows are each answered; an empty table gives an empty result. Texts are told apart by
128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class NearConfig:
    words: int = 5
    similarity: float = 0.8
    sketches: int = 40
    keep: int = 6
    short_sketches: int = 16
    short_keep: int = 2
    short_to: int = 24
    long_from: int = 20
    full_bucket: int = 32
    block: int = 256


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles in order; shorter texts have one shingle, texts without words none."""
    w = common.word_hashes(text)
    if not w.size:
        return w
    n = max(1, w.size - words + 1)
    out = np.zeros(n, np.uint64)
    for t, c in enumerate(common.seeds(words, 0x5E)[: w.size]):
        out += w[t : t + n] * (c | np.uint64(1))
    return common.mix64(out + np.uint64(min(words, w.size)))


def label_occurrences(h: np.ndarray) -> np.ndarray:
    """Make every repeat of a shingle a shingle of its own."""
    ordered = np.sort(h)
    if h.size < 2 or not (ordered[1:] == ordered[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(h.size), 0))
    out = np.empty_like(h)
    out[order] = np.where(first, s, common.mix64(s + (np.arange(h.size) - start).astype(np.uint64)))
    return out


def order_sketches(h: np.ndarray, count: int, keep: int, salt: int, first: int = 0) -> np.ndarray:
    """Sketches first to first + count of the `keep` lowest labelled shingles, hashed in the text's order."""
    some = lambda k: common.seeds(first + count, salt + k)[first:]
    factor, offset = some(0) | np.uint64(1), some(1)
    take, rows = min(keep, h.size), np.arange(count)
    ranks = h[None, :] * factor[:, None] + offset[:, None]
    ranks ^= ranks >> np.uint64(29)
    places = np.empty((count, take), np.int64)
    for t in range(take):
        places[:, t] = ranks.argmin(1)
        ranks[rows, places[:, t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    places.sort(1)
    out = some(2)
    for t in range(take):
        out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[places[:, t]])
    return out


def sketch(text: bytes, cfg: NearConfig) -> tuple[int, np.ndarray]:
    """Number of shingles and all sketches of a text."""
    h = shingles(text, cfg.words)
    if not h.size:
        return 0, h
    labelled, out = label_occurrences(h), []
    if h.size <= cfg.short_to:
        out.append(order_sketches(labelled, cfg.short_sketches, cfg.short_keep, 0x100))
    if h.size >= cfg.long_from:
        step = max(1, min(8, 2_000_000 // h.size))  # bounded memory for very long texts
        out += [order_sketches(labelled, min(step, cfg.sketches - k), cfg.keep, 0x1000, k) for k in range(0, cfg.sketches, step)]
    return h.size, np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence that stays within `band` of the diagonal.

    Equal ends are matched first; the rest is a bit-parallel alignment, one big-integer step per
    element of b, where matches outside the band do not count. Memory grows with the texts, not their square.
    """
    n = min(a.size, b.size)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if differ.size else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[a.size - n :][::-1] != b[b.size - n :][::-1])
    tail = int(differ[0]) if differ.size else n
    a, b = a[: a.size - tail], b[: b.size - tail]
    if not a.size or not b.size:
        return head + tail
    order = np.argsort(a, kind="stable")
    found = a[order]
    first, last = np.searchsorted(found, b, "left").tolist(), np.searchsorted(found, b, "right").tolist()
    place = order.tolist()
    row = full = (1 << a.size) - 1
    for j, (lo, hi) in enumerate(zip(first, last, strict=True)):
        if hi - lo == 1 and abs(place[lo] - j) <= band:
            match = 1 << place[lo]
        elif hi - lo > 1:
            match = _bits(order[lo:hi], j - band, j + band, a.size)
        else:
            continue
        u = row & match
        row = ((row + u) | (row - u)) & full
    return head + tail + a.size - row.bit_count()


def _bits(places: np.ndarray, lo: int, hi: int, size: int) -> int:
    """A number with the bits of those places that are between lo and hi."""
    places = places[(places >= lo) & (places <= hi)]
    if places.size <= 16:
        return sum(1 << p for p in places.tolist())
    mark = np.zeros(size, bool)
    mark[places] = True
    return int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned share of two shingle sequences; 0 where it is certainly below `least`."""
    if not a.size or not b.size or min(a.size, b.size) < least * max(a.size, b.size):
        return 0.0
    n = a.size + b.size
    need = least * n / (1 + least)
    x, y = np.sort(a), np.sort(b)
    common_most = np.minimum(np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left"), 1).sum()
    if common_most < need - 1e-9:
        return 0.0
    m = aligned(a, b, int(n - 2 * need) + 1)
    return m / (n - m)


def _sketch_kernel(cfg: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("near")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [sketch(t.as_py().encode(), cfg) for t in part.column(3)]
                lists = [s.view(np.int64) for _, s in got]
                yield pa.record_batch([*part.columns[:3], pa.array([n for n, _ in got], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "h1", "h2", "n", "sketches"])

    return run


def telling_shingles(own: np.ndarray, inside: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles outside and inside a reference, by hash, of which a partner must share one.

    A partner shares `need` shingles or more. If the reference's shingles alone make that up, one of the
    first (inside - need + 1) inside is shared; if not, at least one and at least (need - inside) outside
    are, hence one of the first (outside - that + 1).
    """
    k = int(inside.sum())
    outer, inner = np.sort(own[~inside]), np.sort(own[inside])
    return outer[: max(0, outer.size - max(1, need - k) + 1)], inner[: max(0, k - need + 1)]


def _reference_kernel(cfg: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("near")
        at, reference, longs = None, np.empty(0, np.uint64), pa.list_(pa.int64())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for k in range(part.num_rows):
                    l = part.column(1)[k].as_py()
                    if l != at:
                        at, reference = l, np.sort(label_occurrences(shingles(part.column(3)[k].as_py().encode(), cfg.words)))
                    own = label_occurrences(shingles(part.column(2)[k].as_py().encode(), cfg.words))
                    has = np.isin(reference, own)
                    outer, inner = telling_shingles(own, np.isin(own, reference), part.column(4)[k].as_py())
                    rows.append((int(has.sum()), np.packbits(np.pad(has, (0, -has.size % 64))).view(np.int64), outer.view(np.int64), inner.view(np.int64)))
                inside, *lists = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(inside, pa.int32()), *(pa.array(x, longs) for x in lists)], names=["node", "l", "inside", "mask", "outer", "inner"])

    return run


def _verify_kernel(cfg: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_turn("near")
        kept: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                nodes = [part.column(0).to_pylist(), part.column(1).to_pylist()]
                good = []
                for k in range(part.num_rows):
                    pair = []
                    for side in (0, 1):
                        node = nodes[side][k]
                        if node not in kept:
                            if size > 4_000_000:
                                kept, size = {}, 0
                            kept[node] = shingles(part.column(2 + side)[k].as_py().encode(), cfg.words)
                            size += kept[node].size
                        pair.append(kept[node])
                    good.append(similarity(*pair, cfg.similarity) >= cfg.similarity)
                keep = pa.array(good, pa.bool_())
                yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return run


#: Columns of the keys of NearDuplicates._split.
KEYED = ("at", "inner", "inside")


class NearDuplicates:
    """One run: tables by node (a distinct text), links, and components."""

    def __init__(self, df: DataFrame, cfg: NearConfig, id_col: str, text_col: str):
        self.spark, self.cfg, self.paths = df.sparkSession, cfg, []
        common.ship(self.spark)
        h1, h2 = text_hashes(text_col)
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), common.whole_text(text_col).alias("text"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder; all but the last ones go when the classes are known."""
        out, path = common.materialize(self.spark, df, f"near-{name}")
        self.paths.append(path)
        return out

    def clear(self, keep: tuple[str, ...]) -> None:
        for path in self.paths:
            if not path.rsplit("/", 1)[1].startswith(tuple(f"pairforge-near-{k}-" for k in keep)):
                common.remove(self.spark, path)

    def _named(self) -> tuple[DataFrame, DataFrame]:
        """(id, h1, h2) of every row, and (node, h1, h2, first_id, label) of every node."""
        signed = self.save(self.docs.mapInArrow(_sketch_kernel(self.cfg), "id long, h1 long, h2 long, n int, sketches array<long>"), "sketches")
        nodes = signed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
        nodes = self.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        rows = nodes.select("node", "n", F.explode("sketches").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = self.save(rows.join(self.save(sizes, "sizes"), "bucket"), "shared")
        fame = self.save(members.groupBy("node").agg(F.sum("size").alias("fame")), "fame")
        members = self.save(members.join(fame, "node"), "members")
        self.texts = self._texts(nodes, members)
        labels = self._link_all(members)
        named = nodes.select("node", "h1", "h2", "first_id").join(labels, "node", "left")
        return signed.select("id", "h1", "h2"), named.withColumn("label", F.coalesce("label", "node"))

    def classes(self) -> DataFrame:
        """(id, class_id) for every row."""
        rows, named = self._named()
        names = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
        of_node = self.save(named.join(self.save(names, "names"), "label").select("h1", "h2", "class_id"), "classes")
        self.clear(keep=("sketches", "classes"))
        return rows.join(of_node, ["h1", "h2"]).select("id", "class_id")

    def survivors(self) -> DataFrame:
        """(id, h1, h2) of one row of each class: the smallest id, null last, then the smallest hashes."""
        _, named = self._named()
        first = named.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "h1", "h2")).alias("x"))
        out = self.save(first.select(F.col("x.first_id").alias("id"), "x.h1", "x.h2"), "survivors")
        self.clear(keep=("survivors",))
        return out

    def _texts(self, nodes: DataFrame, members: DataFrame) -> DataFrame:
        """Text of each node that shares a sketch: read from the row of its smallest id."""
        wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "h1", "h2", "first_id")
        found = self.docs.join(self.save(wanted, "wanted").hint("merge"), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("first_id")))
        return self.save(found.select("node", "text").dropDuplicates(["node"]), "texts")

    def _link_all(self, members: DataFrame) -> DataFrame:
        """(node, label) of linked nodes.

        Leaders first; then small buckets in full and large ones by their references; then what is
        left of the large ones by the shingles that tell their nodes apart.
        """
        self.labels = self.tried = None
        current = self._open(members)
        if current is not None:
            self._compare(self._leader_pairs(current, ["bucket"], 0))
            current = self._open(current.drop("label"))
        if current is not None:
            small = current.where(F.col("size") <= self.cfg.full_bucket)
            led = self._led(current)
            by_reference = led.where((F.col("label") != F.col("l_label")) & self._near(F.col("n"), F.col("l_n"))).select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))
            self._compare(self._all_pairs(small, ["bucket"]).unionByName(by_reference).distinct())
            current = self._open(current.where(F.col("size") > self.cfg.full_bucket).drop("label"))
        if current is not None:
            keyed, told = self._split(current)
            current = self._open(keyed)
            if current is not None:
                small, large = current.where(F.col("size") <= self.cfg.full_bucket), current.where(F.col("size") > self.cfg.full_bucket)
                pairs = self._all_pairs(small, ["l", "s"], ["l"]).unionByName(self._leader_pairs(large, ["l", "s"], 1))
                self._compare(self._possible(pairs.distinct(), told))
                current = self._open(large.drop("label"))
            if current is not None:
                self._compare(self._possible(self._blocked_pairs(current, ["l", "s"], ["l"]), told))
        return self.labels if self.labels is not None else common.literal(self.spark, [], "node long, label long")

    def _near(self, p, q):
        return F.least(p, q) >= self.cfg.similarity * F.greatest(p, q)

    def _open(self, members: DataFrame) -> DataFrame | None:
        """Members with their labels, of buckets or keys that hold several labels; None if there are none."""
        keys = ["bucket"] if "bucket" in members.columns else ["l", "s"]
        if self.labels is None:
            current = members.withColumn("label", F.col("node"))
        else:
            current = members.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            spread = current.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*keys)
            current = current.join(spread, keys, "left_semi")
        current = self.save(current, "open")
        return None if current.isEmpty() else current

    def _compare(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) that were not tried, and merge labels over the links."""
        pairs = self.save(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.labels = self._merge(self.labels, self._verify(pairs))

    def _leader_pairs(self, current: DataFrame, keys: list[str], turn: int) -> DataFrame:
        """Each node with the leader of its bucket: at first the node that shares most sketches with
        others, the likely centre of its copies; later ones are chosen by hash."""
        order = F.struct(-F.col("fame") if turn == 0 else F.lit(0), F.xxhash64("node", F.lit(turn)))
        lead = current.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "node", "label", "n")).alias("x"))
        lead = self.save(lead.select(*keys, F.col("x.node").alias("led_by"), F.col("x.label").alias("l_label"), F.col("x.n").alias("l_n")), "leaders")
        met = current.join(lead, keys).where((F.col("label") != F.col("l_label")) & self._near(F.col("n"), F.col("l_n")))
        return met.select(*[k for k in keys if k == "l"], F.least("node", "led_by").alias("a"), F.greatest("node", "led_by").alias("b")).distinct()

    def _all_pairs(self, current: DataFrame, keys: list[str], out: list[str] | None = None) -> DataFrame:
        """Pairs across labels within each key."""
        own = [c for c in ("node", "label", "n", *KEYED) if c in current.columns]
        p = current.select(*keys, *own)
        q = p.toDF(*keys, *(f"m_{c}" for c in own))
        return p.join(q, keys).where((F.col("node") < F.col("m_node")) & self._meet(p)).select(*(out or []), F.col("node").alias("a"), F.col("m_node").alias("b")).distinct()

    def _meet(self, p: DataFrame):
        """Whether two members of a key are to be compared. If a key of `_split` is the first that they share, they
        share no more than what either has from there on, and of what is inside the reference no more than either has."""
        good = (F.col("label") != F.col("m_label")) & self._near(F.col("n"), F.col("m_n"))
        if "at" in p.columns:
            of = lambda m: F.when(F.col("inner"), F.col(f"{m}inside")).otherwise(F.col(f"{m}n") - F.col(f"{m}inside")) - F.col(f"{m}at")
            inside = F.when(F.col("inner"), F.lit(0)).otherwise(F.least("inside", "m_inside"))
            good = good & (F.least(of(""), of("m_")) + inside >= self._enough(F.col("n") + F.col("m_n")))
        return good

    def _enough(self, n):
        """The least number of shared shingles for two texts with n shingles together."""
        return self.cfg.similarity / (1 + self.cfg.similarity) * n - 1e-9

    def _blocked_pairs(self, current: DataFrame, keys: list[str], out: list[str]) -> DataFrame:
        """The same for large keys: members are dealt into blocks, and every two blocks meet in a task of their own."""
        blocks = F.ceil(F.col("size") / self.cfg.block).cast("int")
        p = current.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        p = p.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "n", *KEYED)
        both = [*keys, "lo", "hi"]
        q = p.toDF(*both, *(f"m_{c}" for c in p.columns[len(both) :]))
        good = (F.col("own") == F.col("lo")) & (F.col("m_own") == F.col("hi")) & ((F.col("lo") < F.col("hi")) | (F.col("node") < F.col("m_node"))) & self._meet(p)
        return p.join(q, both).where(good).select(*out, F.least("node", "m_node").alias("a"), F.greatest("node", "m_node").alias("b")).distinct()

    def _led(self, current: DataFrame) -> DataFrame:
        """(node, label, n, l, l_label, l_n) of large buckets: l is the bucket's reference, the node of most
        fame in the component that has most nodes in it. Buckets of one component have one reference."""
        large = current.where(F.col("size") > self.cfg.full_bucket)
        shares = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.max("fame").alias("f"))
        lead = shares.groupBy("bucket").agg(F.max(F.struct("c", "f", "label")).alias("x")).select("bucket", F.col("x.label").alias("l_label"))
        best = large.groupBy("label").agg(F.min(F.struct((-F.col("fame")).alias("f"), "node", "n")).alias("x"))
        best = best.select(F.col("label").alias("l_label"), F.col("x.node").alias("l"), F.col("x.n").alias("l_n"))
        lead = self.save(lead.join(best, "l_label"), "references")
        return self.save(large.join(lead, "bucket").select("node", "label", "n", "l", "l_label", "l_n").distinct(), "led")

    def _split(self, current: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of keys (l, s) and, by (node, l), what a node shares with its reference l.

        Two nodes of a bucket that reach the similarity share a telling shingle s (`telling_shingles`),
        outside their reference or inside it, where `need` is what the shortest possible partner asks: for
        nodes of the reference's component a partner is a stranger to it. That the reference's shingles are
        enough asks for a stranger that has enough of them for its own and its partner's length; other
        groups need no rows for what is inside. Only keys that several components share are kept, and keys
        with the same two smallest hashes of members are one: a passage that many texts share is not many keys.
        """
        led, share = self._led(current), self.cfg.similarity / (1 + self.cfg.similarity)
        own_side = F.col("label") == F.col("l_label")
        lengths = led.groupBy("l").agg(F.min("n").alias("any_n"), F.min(F.when(~own_side, F.col("n"))).alias("other_n"))
        partner = F.greatest(F.ceil(self.cfg.similarity * F.col("n") - 1e-9), F.when(own_side, F.col("other_n")).otherwise(F.col("any_n")))
        led = led.join(self.save(lengths.where("other_n IS NOT NULL"), "lengths"), "l").withColumn("partner_n", partner).where(self._near(F.col("n"), F.col("partner_n")))
        led = led.withColumn("need", F.ceil(share * (F.col("n") + F.col("partner_n")) - 1e-9).cast("int")).drop("any_n", "other_n", "partner_n")
        side = lambda key, name: self.texts.select(F.col("node").alias(key), F.col("text").alias(name)).hint("merge")
        pairs = led.select("node", "l", "need").join(side("node", "tn"), "node").join(side("l", "tl"), "l").select("node", "l", "tn", "tl", "need")
        told = self.save(pairs.mapInArrow(_reference_kernel(self.cfg), "node long, l long, inside int, mask array<long>, outer array<long>, inner array<long>"), "told")
        both = led.join(told, ["node", "l"])
        enough = lambda partner: F.col("inside") >= self._enough(F.col("n") + F.col(partner))
        within = both.where(F.size("inner") > 0)
        shortest = within.groupBy("l").agg(F.min("n").alias("any_n"))
        stranger = (F.col("label") != F.col("l_label")) & enough("any_n")
        bounds = self.save(within.join(shortest, "l").where(stranger).groupBy("l").agg(F.min("n").alias("stranger_n"), F.min("any_n").alias("any_n")), "bounds")
        within = within.join(bounds, "l").where(stranger | enough("stranger_n"))
        shown = lambda df, side: df.select("l", "node", "label", "n", "inside", F.lit(side == "inner").alias("inner"), F.posexplode(side).alias("at", "s"))
        rows = self.save(shown(both, "outer").unionByName(shown(within, "inner")), "telling")
        one = lambda salt: F.min(F.xxhash64("node", F.lit(salt))).alias(f"m{salt}")
        keys = rows.groupBy("l", "s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), one(1), one(2)).where("lo <> hi").select("l", "s", "m1", "m2")
        folded = rows.join(keys, ["l", "s"]).groupBy("l", F.xxhash64("inner", "m1", "m2").alias("s"), "node").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("n", "inner", "inside")))
        folded = self.save(folded, "folded")
        keyed = folded.join(folded.groupBy("l", "s").agg(F.count(F.lit(1)).alias("size")), ["l", "s"])
        return self.save(keyed, "keyed"), self.save(both.select("node", "l", "mask", (F.col("n") - F.col("inside")).alias("outside"), "n"), "masks")

    def _possible(self, pairs: DataFrame, told: DataFrame) -> DataFrame:
        """Pairs (l, a, b) that can reach the similarity: they share at most the reference's shingles that
        both have, and of the others no more than either has."""
        side = lambda p: told.toDF(p, "l", f"{p}_mask", f"{p}_outside", f"{p}_n")
        met = pairs.join(side("a"), ["a", "l"]).join(side("b"), ["b", "l"])
        both = F.aggregate(F.zip_with("a_mask", "b_mask", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, x: t + x)
        return met.where(both + F.least("a_outside", "b_outside") >= self._enough(F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()

    def _verify(self, pairs: DataFrame) -> DataFrame:
        side = lambda key, name: self.texts.select(F.col("node").alias(key), F.col("text").alias(name))
        both = pairs.join(side("a", "ta").hint("merge"), "a").join(side("b", "tb").hint("merge"), "b").select("a", "b", "ta", "tb")
        return self.save(both.mapInArrow(_verify_kernel(self.cfg), "a long, b long"), "links")

    def _merge(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Labels after links: components of the graph whose nodes are the old labels."""
        if labels is None:
            edges = links
        else:
            of = lambda key: labels.select(F.col("node").alias(key), F.col("label").alias(f"{key}_label"))
            edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            edges = edges.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
        fresh, path = components(self.spark, self.save(edges, "edges"))
        self.paths.append(path)
        if labels is None:
            return fresh
        moved = labels.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = fresh.join(labels.select("node"), "node", "left_anti")
        return self.save(moved.unionByName(new), "labels")


def components(spark, edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) with label the smallest node of the component, and the table's path; edges (a, b).

    Every node takes the smallest label around it, then the label of its label, until nothing changes.
    """
    keep = lambda df, name: common.materialize(spark, df, f"components-{name}")
    both, edge_path = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "edges")
    labels, path = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower, lower_path = keep(labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lower")
        jump = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        jumped, jumped_path = keep(jump.select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")), "jumped")
        for old in (path, lower_path):
            common.remove(spark, old)
        labels, path = jumped.select("node", "label"), jumped_path
        if jumped.where("old <> label").isEmpty():
            common.remove(spark, edge_path)
            return labels, path


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearConfig | None = None) -> DataFrame:
    """The class of every row: (id, class_id), class_id being the class's smallest id."""
    return NearDuplicates(df, cfg or NearConfig(), id_col, text_col).classes().withColumnRenamed("id", id_col)


def text_hashes(text_col: str) -> tuple[Column, Column]:
    """128 bits by which texts are told apart."""
    text = common.whole_text(text_col)
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearConfig | None = None) -> DataFrame:
    """One row of each class: that of the smallest id, a null id last; of several texts with it, one."""
    first = NearDuplicates(df, cfg or NearConfig(), id_col, text_col).survivors()
    key = lambda i, *hashes: F.struct(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none"), *hashes).alias("key")
    first = first.select(key(F.col("id"), F.col("h1").alias("h1"), F.col("h2").alias("h2")))
    one, two = text_hashes(text_col)
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), key(df[id_col].cast("long"), one.alias("h1"), two.alias("h2")))
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op6_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
