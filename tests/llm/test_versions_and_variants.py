"""Three-way merges, streaming deduplication and spelling variants against plain versions and in odd cases."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairforge.llm import branch_merge, spelling, stream_dedup
from pairforge.shared import literal, scratch

TAGS = "doc_id long, kind int, place int, slot int, branch int, present boolean, value string, lang string, source string"


def merged(rows):
    """The plain sweep over rows of (doc_id, kind, place, slot, branch, present, value), the text and columns of the base filled in."""
    return list(branch_merge.three_cursor_merge(iter(sorted([(*r, None, None) if len(r) == 7 else r for r in rows], key=lambda r: r[:5]))))


def document(doc_id, lines, lang="l", source="s"):
    return [(doc_id, 0, 0, 0, 0, True, None), (doc_id, 1, 0, 0, 0, True, lang), (doc_id, 1, 1, 0, 0, True, source), *((doc_id, 2, k, 0, 0, True, x) for k, x in enumerate(lines))]


@pytest.mark.parametrize(
    ("edits", "text", "counts"),
    [
        ([], "a\nb", (0, 0, 0, 0)),
        ([(2, 0, 0, 1, True, "x")], "x\nb", (1, 0, 0, 0)),
        ([(2, 0, 0, 1, True, "x"), (2, 0, 0, 2, True, "x")], "x\nb", (1, 0, 0, 0)),
        ([(2, 0, 0, 1, True, "x"), (2, 0, 0, 2, True, "y")], "y\nb", (0, 1, 0, 0)),
        ([(2, 0, 0, 1, False, None), (2, 0, 0, 2, True, "y")], "y\nb", (0, 0, 1, 0)),
        ([(2, 0, 0, 1, True, "x"), (2, 0, 0, 2, False, None)], "b", (0, 0, 1, 0)),
        ([(2, 0, 1, 1, True, "i"), (2, 0, 1, 2, True, "j")], "a\nj\nb", (0, 0, 0, 1)),
        ([(2, 0, 0, 1, False, None), (2, 0, 1, 2, True, "j")], "j\nb", (2, 0, 0, 0)),
        ([(2, 0, 0, 1, False, None), (2, 1, 0, 2, False, None)], "", (2, 0, 0, 0)),
        ([(0, 0, 0, 1, False, None)], None, (1, 0, 0, 0)),
        ([(0, 0, 0, 1, False, None), (2, 0, 0, 1, True, "x")], None, (1, 0, 0, 0)),
        ([(0, 0, 0, 1, False, None), (2, 0, 0, 2, True, "y"), (2, 1, 0, 1, True, "x")], "y\nb", (0, 0, 1, 0)),
        ([(0, 0, 0, 2, False, None), (2, 0, 0, 1, True, "x")], None, (0, 0, 1, 0)),
        ([(0, 0, 0, 1, False, None), (0, 0, 0, 2, False, None), (2, 0, 0, 1, True, "x")], None, (1, 0, 0, 0)),
        ([(2, 0, 0, 1, True, "a")], "a\nb", (0, 0, 0, 0)),
    ],
)
def test_units_of_a_document(edits, text, counts):
    (doc,) = merged([*document(7, ["a", "b"]), *((7, *e) for e in edits)])
    assert doc[0] == 7 and doc[1] == (text is not None) and doc[4] == text and doc[5:] == counts
    assert doc[2:4] == (("l", "s") if text is not None else (None, None))


def test_columns_and_added_rows():
    rows = [*document(1, [""]), (1, 1, 0, 0, 1, True, ""), (1, 1, 1, 0, 1, True, "t"), (1, 1, 1, 0, 2, True, "u")]
    rows += [(2, 3, 0, 0, 1, True, "!", "l", "s"), (3, 3, 0, 0, 1, True, "!", "l", "s"), (3, 3, 0, 0, 2, True, "!", "l", "s"), (4, 3, 0, 0, 1, True, "!", "l", "s"), (4, 3, 0, 0, 2, True, "?", "l", "s")]
    rows += [*document(5, ["z"]), (5, 3, 0, 0, 1, True, "!", "l", "s")]
    assert merged(rows) == [(1, True, "", "u", "", 1, 1, 0, 0), (2, True, "l", "s", "!", 1, 0, 0, 0), (3, True, "l", "s", "!", 1, 0, 0, 0), (4, True, "l", "s", "?", 0, 0, 0, 1), (5, True, "l", "s", "z", 0, 0, 0, 0)]


def plain_merge(doc_id, text, lang, source):
    """The rows of one document by the rules, units in dictionaries."""
    code = lambda b, name: zlib.crc32(f"{b}:{'' if doc_id is None else doc_id}:{name}".encode()) % 7
    base = {("c", "lang"): lang or "", ("c", "source"): source or ""} | {("l", k): x for k, x in enumerate((text or "").split("\n"))}
    sides = {}
    for b in "LR":
        state = dict(base)
        for (kind, name), v in base.items():
            c = code(b, name)
            if c in (1, 2):
                state[kind, name] = v + "!?"[c - 1]
            elif c == 0:
                state[kind, name] = "" if kind == "c" else None
            elif kind == "l" and c in (3, 4):
                state["g", name] = "!?"[c - 3]
        sides[b] = state
    left, right = sides["L"], sides["R"]
    units = {u: (base.get(u), left.get(u), right.get(u)) for u in base.keys() | left.keys() | right.keys()}
    counts, take = [0, 0, 0, 0], {}
    for u, (o, x, y) in units.items():
        take[u] = y if y != o else x
        if x != o and y != o and x != y:
            counts[3 if u[0] == "g" else 2 if None in (x, y) else 1] += 1
        elif x != o or y != o:
            counts[0] += 1
    gone = {b: code(b, "row") == 0 for b in "LR"}
    if gone["L"] or gone["R"]:
        lost = gone["L"] != gone["R"] and (right if gone["L"] else left) != base
        counts, take = [int(not lost), 0, int(lost), 0], right if lost and gone["L"] else None
    out = []
    if take is None:
        out.append((doc_id, None, None, None, *counts))
    else:
        lines = [take[u] for u in sorted((u for u in take if u[0] in "lg"), key=lambda u: (u[1], u[0] == "g")) if take[u] is not None]
        out.append((doc_id, take["c", "lang"], take["c", "source"], "\n".join(lines), *counts))
    added = {b: "!?"[code(b, "row") - 3] for b in "LR" if code(b, "row") in (3, 4)}
    if added and doc_id is not None:
        clash = len(set(added.values())) == 2
        out.append((-1 - doc_id, lang or "", source or "", added.get("R", added.get("L")), int(not clash), 0, 0, int(clash)))
    return out


def test_merge_equals_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["", "a", "é b", "!"]) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "", None]), rng.choice(["x", None])) for i in range(120)]
    rows += [(1000, None, None, None), (None, "no\nid", "en", "x"), (1001, "\n" * 5000, "en", "x"), (1002, "y" * 50_000, "en", "x")]
    docs = literal(spark, rows, "doc_id long, text string, lang string, source string").withColumn("kind", F.lit("c")).withColumn("branch", F.lit(5)).withColumn("value", F.lit(1))
    got = branch_merge.merge_documents(docs.repartition(3)).select("doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for r in rows for x in plain_merge(r[0], r[1], r[2], r[3]))
    again = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id = 3").withColumn("text", F.concat("text", F.lit("~"))))
    repeated = branch_merge.merge_documents(again).collect()
    assert len(repeated) == len(got)
    assert branch_merge.merge_documents(docs.where("false")).collect() == []


TEXTS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "c"), (None, "c"), (3, "a"), (6, "x" * 100_000), (7, "x" * 100_000), (8, "a"), (9, "a\n"), (10, "A")]


def plain_dedup(rows):
    best = {}
    for i, t in rows:
        t = t or ""
        n, top = best.get(t, (0, None))
        best[t] = n + 1, i if top is None else top if i is None else max(i, top)
    out = Counter((i, best[t or ""][1], best[t or ""][0]) for i, t in rows)
    return out, {t: top for t, (_, top) in best.items()}


@pytest.mark.parametrize("bits", [64, 2, 0])
@pytest.mark.parametrize("few", [0, 1000])
def test_streaming_deduplication(spark, bits, few):
    """Digests of 64, 2 and 0 hex digits: texts that share one are told apart. Several batches, one file each."""
    rows = TEXTS + [(100 + k, "hot") for k in range(60)] + [(200 + k, f"t{k % 17}") for k in range(40)]
    path = scratch(spark, "texts")
    literal(spark, rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("file", F.lit("f")).withColumn("best", F.lit(2)).repartition(5).write.parquet(path)
    digest = (lambda t: F.unhex(F.sha2(t, 256))) if bits == 64 else lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, bits // 2)
    cfg = stream_dedup.DedupConfig(batch_bytes=1, salted=4, few_classes=few, digest=digest)
    got = stream_dedup.deduplicated(spark, path, cfg).collect()
    want, best = plain_dedup(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(best) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_state_outlives_a_run(spark):
    path, folder = scratch(spark, "texts"), scratch(spark, "dedup")
    first, second = [(k, f"t{k % 5}") for k in range(20)], [(k, f"t{k % 7}") for k in range(20, 50)]
    cfg = stream_dedup.DedupConfig(batch_bytes=1)
    for rows in (first, second):
        literal(spark, rows, "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
        stream = stream_dedup.StreamingDeduplicator(spark, path, folder, cfg)
        stream.advance()
        stream.advance()
    want, _ = plain_dedup(first + second)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in stream.result().collect()) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stream_dedup.ROCKSDB


def test_deduplication_of_nothing(spark):
    path = scratch(spark, "texts")
    literal(spark, [(1, "a")], "doc_id long, text string").where("false").write.parquet(path)
    assert stream_dedup.deduplicated(spark, path).collect() == []


def plain_variants(docs):
    counts = Counter()
    for i, text in docs:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += len(word) >= 7
                run = ""
    n = {w: c for w, c in counts.items() if c >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize(("hot", "shard"), [(2000, 12_000), (2, 40), (0, 7)])
def test_spelling_variants(spark, hot, shard):
    rng = random.Random(9)
    stems = ["abababab", "aaaaaaa", "aaaaaaaa", "zebrafish", "éclairage", "ÿÿÿÿÿÿÿÿ", "Translate", "transLATES"]
    words = []
    for s in stems:
        words += [s] * rng.choice([3, 40, 700])
        for _ in range(25):
            k, ch = rng.randrange(len(s) + 1), rng.choice("abzé×")
            words += [rng.choice([s[:k] + ch + s[k:], s[:k] + ch + s[k + 1 :], s[:k] + s[k + 1 :]])] * rng.choice([1, 2, 3, 30])
    rng.shuffle(words)
    docs = [(k, rng.choice([" ", "-", "1"]).join(words[k::40])) for k in range(40)] + [(None, "abababab, null id"), (5, None), (6, ""), (5, "zebrafish zebrafish"), (5, "zebrafish zebrafish"), (7, "q" * 5000 + " " + "q" * 5000)]
    df = literal(spark, docs, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("run", F.lit("r"))
    cfg = spelling.SpellingConfig(hot=hot, shard=shard)
    got = [tuple(r) for r in spelling.spelling_variants(df.repartition(3), cfg).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)
    assert spelling.spelling_variants(df.where("false"), cfg).collect() == []


def test_roots_follow_chains(spark):
    forms = literal(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "f") for w in "abcde"} | {("x", "y")}
    assert spelling.roots(forms.where("false")).collect() == []


def test_automaton_checks_places_and_lengths():
    shard = spelling.HalvesAutomaton()
    shard.add("abcdefg", 5, False, "abc", None)
    shard.add("abcdefg", 5, True, "defg", None)
    shard.build()
    assert set(shard.scan("abcxdefg")) == {(False, "abc"), (True, "defg")}
    assert set(shard.scan("xabcdefg")) == {(True, "defg")} and set(shard.scan("abcdefghijk")) == set()
    assert list(shard.neighbours("abcdefgh", False, "abc", None)) == [("abcdefg", 5)] and list(shard.neighbours("abcxdefg", True, "defg", None)) == []
