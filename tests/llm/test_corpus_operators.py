"""WARC index, near duplicates, PPM, search, hosts, toxicity and the pipeline against plain versions."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import hostrep, order_minhash, ordinal_tox, ppm, topk, warc_index
from pairforge.llm.catalog import ORACLE_SQL, QUERIES
from pairforge.shared import literal

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    assert columns == sorted(df.columns)
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_warc_query_is_ordered_and_whole(spark):
    pages = {r["page_id"]: r for r in read(spark, "pages").collect()}
    rows = warc_index.archive_and_index(read(spark, "pages")).collect()
    assert len(rows) == len(pages)
    first = {}
    for i in sorted(pages):
        first.setdefault(hashlib.sha1((pages[i]["html"] or "").encode()).digest(), i)
    for r in rows:
        data = (pages[r["page_id"]]["html"] or "").encode()
        f = first[hashlib.sha1(data).digest()]
        want = ("response", None) if f == r["page_id"] else ("revisit", f)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *want)
    keys = [(r["surt"], r["timestamp"], r["page_id"]) for r in sorted(rows, key=lambda r: (r["range"], r["ordinal"]))]
    assert keys == sorted(keys)


@pytest.mark.parametrize("hot", [1, 20, 1 << 40])
def test_many_runs_are_merged_in_passes(spark, monkeypatch, hot):
    """Merges in passes and ranges; payloads that many pages share, broadcast or not."""
    monkeypatch.setattr(warc_index, "HOT", hot)
    rows = [(i, f"http://h{i % 7}.net/{i % 13}", f"page {i % 40}") for i in range(300)]
    pages = literal(spark, rows, "page_id long, url string, html string").repartition(4)
    cfg = warc_index.WarcConfig(fan_in=3, archive_records=11, batch=4, sample=64)
    got = warc_index.archive_and_index(pages, cfg).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: i % 40 if i >= 40 else None for i in range(300)}
    keys = [(r["surt"], r["timestamp"], r["page_id"]) for r in sorted(got, key=lambda r: (r["range"], r["ordinal"]))]
    assert len(keys) == 300 and keys == sorted(keys)
    assert sum(r["record_type"] == "response" for r in got) == 40


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_equals_sort(k):
    rng = random.Random(k)

    class Run:
        def __init__(self, keys):
            self.keys, self.at = keys, 0

        @property
        def key(self):
            return self.keys[self.at] if self.at < len(self.keys) else None

        @property
        def row(self):
            return self.keys[self.at]

        def advance(self):
            self.at += 1

    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(warc_index.LoserTree([Run(r) for r in runs])) == sorted(itertools.chain(*runs))


def test_surt_and_record_ids():
    assert warc_index.surt("http://Blog.Example.net:8080/a?b=1#c") == "net,example,blog:8080)/a?b=1"
    assert warc_index.surt("http://a.com") == "com,a)/" and warc_index.surt(None) == ""
    assert [warc_index.page_of(warc_index.record_id(i)) for i in (0, 7, -5, 1 << 62)] == [0, 7, -5, 1 << 62]
    assert warc_index.page_of(warc_index.record_id(None, 3)) is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.choice([0, 1, 1])] = [f"new{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return out


def test_banded_alignment_decides_like_a_full_one():
    rng, cfg = random.Random(1), order_minhash.NearConfig()
    near = 0
    for _ in range(200):
        words = [f"w{rng.randrange(rng.choice([5, 3000]))}" for _ in range(rng.randrange(5, 90))]
        a = order_minhash.shingles(" ".join(words).encode(), 5)
        other = " ".join(edited(rng, words, rng.randrange(5))).encode()
        b = order_minhash.shingles(other, 5)
        if not b.size:
            continue
        m = lcs(a.tolist(), b.tolist())
        want = m / (a.size + b.size - m)
        got = order_minhash.similarity(a, b, 0.8)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))
        if want >= 0.8:
            near += 1
            assert set(order_minhash.sketch(" ".join(words).encode(), cfg)[1].tolist()) & set(order_minhash.sketch(other, cfg)[1].tolist())
    assert near > 50


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 60, 150]))]
        for _ in range(rng.choice([1, 2, 60])):
            texts.append(" ".join(edited(rng, base, rng.randrange(0, 5))))
    passage = " ".join(f"common{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{i}x{j}" for j in range(50)) for i in range(60)]
    texts += texts[:20]
    df = literal(spark, list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cfg = order_minhash.NearConfig(full_bucket=8, block=4)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df, cfg=cfg).collect()}
    sh = [order_minhash.shingles(t.encode(), 5) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if root(i) != root(j) and (texts[i] == texts[j] or order_minhash.similarity(sh[i], sh[j], 0.8) >= 0.8):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert got == {i: root(i) for i in range(len(texts))}
    kept = {r["doc_id"] for r in order_minhash.keep_one(df, cfg=cfg).collect()}
    assert kept == {root(i) for i in range(len(texts))}


def test_keep_one_keeps_one_row_of_every_class(spark):
    """Repeated ids with different texts, ids in two classes, null ids beside others and alone."""
    a, b, c, d = (" ".join(f"{x}{j}" for j in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (1, b + " more"), (2, b), (None, a), (None, c), (None, c), (5, d), (4, d + " more"), (None, None), (7, "")]
    df = literal(spark, rows, "doc_id long, text string").withColumn("_other", F.lit(1))
    out = order_minhash.keep_one(df)
    assert out.columns == df.columns
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"][:1]) for r in out.collect()))
    assert kept == [(False, 1, "a"), (False, 1, "b"), (False, 4, "d"), (False, 7, ""), (True, 0, "c")]


def test_last_comparison_keeps_links_of_leaders(spark):
    """Buckets of 12 texts with tied fame, in pairs at similarity 0.85; every one has shingles of its own."""
    texts = []
    for g in range(40):
        core = [f"g{g}c{j}" for j in range(76)]
        for p in range(6):
            shared = [f"g{g}p{p}s{j}" for j in range(20)]
            texts += [" ".join([*core, *shared, *(f"g{g}p{p}t{t}o{j}" for j in range(8))]) for t in (0, 1)]
    cfg = order_minhash.NearConfig(sketches=1, keep=1, short_to=0, long_from=1, full_bucket=2, block=3)
    sketches = [tuple(order_minhash.sketch(t.encode(), cfg)[1].tolist()) for t in texts]
    together = [g for g in range(40) if len(set(sketches[12 * g : 12 * g + 12])) == 1][:6]
    assert len(together) == 6
    rows = [(i, texts[i]) for g in together for i in range(12 * g, 12 * g + 12)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(literal(spark, rows, "doc_id long, text string"), cfg=cfg).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_sketches_keep_order_and_do_not_depend_on_blocks():
    h = order_minhash.label_occurrences(order_minhash.shingles(b"a b c d e f g a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3", 5))
    assert len(set(h.tolist())) == h.size
    whole = order_minhash.order_sketches(h, 8, 6, 0x1000)
    assert (np.concatenate([order_minhash.order_sketches(h, 1, 6, 0x1000, k) for k in range(8)]) == whole).all()
    assert (order_minhash.order_sketches(h[::-1], 8, 6, 0x1000) != whole).all()


def test_ppm_equals_a_trie(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower() for r in read(spark, "documents").limit(60).collect()}
    df = read(spark, "documents").where(F.col("doc_id").isin(list(docs)))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    order = ppm.PpmConfig().order
    tries = [defaultdict(Counter) for _ in range(order + 1)]
    words = Counter()
    for i, t in docs.items():
        if not held[i]:
            words.update(t.split())
            words[None] += 1
            raw = b"\xfe" * order + t + b"\xff"
            for p in range(order, len(raw)):
                for k in range(order + 1):
                    tries[k][raw[p - k : p]][raw[p]] += 1

    def code(context, symbol):
        total, out = 0.0, set()
        for k in range(order, -1, -1):
            seen = tries[k].get(context[order - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
            if left:
                total += math.log10(len(left) / (2 * sum(left.values())))
            out = set(seen)
        return total - math.log10(256 - len(out))

    assert {h for h in held.values()} == {True, False}
    n, v = sum(words.values()), len(words)
    for r in ppm.score_documents(df, ppm.held_out_tenth, cfg=ppm.PpmConfig(block_bytes=20_000, least_block=5_000, slice_bytes=3_000)).collect():
        t = docs[r["doc_id"]]
        raw = b"\xfe" * order + t + b"\xff"
        tokens = [*t.split(), None]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in words for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(sum(code(raw[p - order : p], raw[p]) for p in range(order, len(raw))), rel=1e-9)


def test_lookup_finds_all_and_nothing_else():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    box = ppm.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=float))
    value, there = box.get(keys)
    assert there[::2].all() and not there[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_search_equals_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 17))
    x = (centers[rng.integers(0, 5, 400)] + 0.2 * rng.normal(size=(400, 17))) * scale
    x[50:80] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    cfg = topk.SearchConfig(k=7, seeds=40, query_block=9, candidate_block=64)
    got = defaultdict(list)
    for r in topk.top_k(df, lambda i: i % 20 == 0, cfg=cfg).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(64 * x).astype(np.int64).astype(object)
    for i in range(0, 400, 20):
        s = [max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in q @ q[i]]
        want = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:7]
        assert got[i] == [(j, s[j]) for j in want]


@pytest.mark.parametrize("distinct", [True, False])
def test_search_with_repeated_ids(spark, distinct):
    """A third of the rows repeats one id with the best products; each id, or each row, takes its places."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    ids = np.arange(300)
    ids[::3] = 7
    x[::3] = 3 * x[20] + 0.01 * rng.normal(size=(100, 6))
    x[281] = x[20] + 0.3
    ids[281] = 20
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    cfg = topk.SearchConfig(k=8, seeds=60, query_block=4, candidate_block=64, distinct=distinct)
    got = defaultdict(list)
    for r in topk.top_k(df, lambda i: i % 20 == 0, cfg=cfg).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(64 * x).astype(np.int64)
    want = defaultdict(list)
    for row in np.flatnonzero(ids % 20 == 0):
        want[int(ids[row])] += [(int(j), int(s)) for j, s in zip(ids, q @ q[row], strict=True) if j != ids[row]]
    for i, pairs in want.items():
        if distinct:
            pairs = [(j, max(s for k, s in pairs if k == j)) for j in {j for j, _ in pairs}]
        assert got[i] == sorted(pairs, key=lambda p: (-p[1], p[0]))[:8]
    assert set(got) == set(want)


def test_topk_query_equals_sql_with_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i if i % 3 else 1, (rng.normal(size=8) + 2 * (i % 3 == 0)).tolist()) for i in range(200)]
    rows += [(20, rng.normal(size=8).tolist()), (20, rows[20][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op8_topk']})").fetchall())
    got = QUERIES["op8_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-90, 90, (50, 30)), rng.integers(-90, 90, (60, 30))
    exact = a @ b.T
    last = None
    for s in (1, 4, 16, 30):
        bound = topk.segment_features(a.astype(float), s) @ topk.segment_features(b.astype(float), s).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.sum() <= last + 1e-6 or s == 4
        last = bound.sum()


def test_rules_and_reputation(spark):
    urls = ["http://a.com/en/1", "http://www.Example.com/en/7?x", "http://x.net/de/1", "http://example.net/de/8", "http://notexample.net/de/8", "http://b.org/es/", "http://com/en/", "https://bad.info/x", "https://good.info/x"]
    pages = literal(spark, [(k, u) for k, u in enumerate(urls)] + [(100 + k, "https://bad.info/p") for k in range(60)] + [(200 + k, "https://good.info/p") for k in range(60)] + [(300, "https://few.info/p")], "page_id long, url string")
    outcomes = literal(spark, [(100 + k, True) for k in range(60)] + [(200 + k, False) for k in range(60)] + [(300, True)], "id long, bad boolean")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in hostrep.filter_urls(pages, outcomes, hostrep.RULES).collect()}
    assert [out[k] for k in range(9)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), ("com/en/", "block"), (None, "block"), (None, "allow")]
    assert out[300] == (None, "allow")
    plan = hostrep.filter_urls(pages, outcomes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    rows, cols = np.repeat(np.arange(40), 3), rng.integers(0, 6, 120)
    grade, w, theta = rng.integers(0, 3, 40), rng.normal(size=6), np.array([-0.5, 0.7])
    _, gw, gt = ordinal_tox.loss_and_gradient(w, theta, rows, cols, grade, 0.1)
    for at, g in ((w, gw), (theta, gt)):
        for k in range(at.size):
            at[k] += 1e-6
            up = ordinal_tox.loss_and_gradient(w, theta, rows, cols, grade, 0.1)[0]
            at[k] -= 2e-6
            down = ordinal_tox.loss_and_gradient(w, theta, rows, cols, grade, 0.1)[0]
            at[k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[k], abs=1e-5)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), ordinal_tox.toxic_labels(spark, sf)
    cfg = ordinal_tox.ToxicityConfig()
    held = labels.where("id % 3 = 0")
    model = ordinal_tox.fit_toxicity(docs, labels.where("id % 3 <> 0"), cfg)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = ordinal_tox.toxicity(docs, model, cfg).join(held, F.col("doc_id") == F.col("id")).select("toxic", held["grade"].alias("y"), "severity").collect()
    # about one toxic label in fifteen is on a text without any telling word
    tp, fp = sum(r["toxic"] and r["y"] == 1 for r in out), sum(r["toxic"] and r["y"] == 0 for r in out)
    assert tp / sum(r["y"] == 1 for r in out) > 0.85 and fp / sum(r["y"] == 0 for r in out) < 0.01


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        if k < 3:
            assert docs.columns == before.columns
            docs = docs.persist()
            assert 0 < docs.count() <= before.count()
    last = docs.collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in before.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in last}


def test_severities_order_graded_rows_that_were_held_out(spark):
    """Four grades, each with words of its own and some of the grade below: severities follow the grades."""
    rng = random.Random(11)
    words = {g: [f"grade{g}word{k}" for k in range(12)] for g in range(1, 4)}
    rows = []
    for i in range(900):
        g = rng.choices(range(4), (60, 20, 12, 8))[0]
        text = [f"plain{rng.randrange(300)}" for _ in range(40)]
        for level in range(1, g + 1):
            text += rng.sample(words[level], 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), g))
    df = literal(spark, rows, "doc_id long, text string, y int")
    labels = df.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("y").alias("grade"))
    model = ordinal_tox.fit_toxicity(df, labels, ordinal_tox.ToxicityConfig())
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    out = ordinal_tox.toxicity(df, model).join(df.select("doc_id", "y"), "doc_id").where("doc_id % 2 = 1").collect()
    mean = [np.mean([r["severity"] for r in out if r["y"] == g]) for g in range(4)]
    assert all(b > a + 0.5 for a, b in itertools.pairwise(mean))
    assert np.mean([r["grade"] == r["y"] for r in out]) > 0.8


def test_toxicity_query_equals_the_model_by_hand(spark):
    """Words and beginnings counted plainly, sigmoids of their weights' sum less each threshold, summed up."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal_tox.fit_toxicity(docs, ordinal_tox.toxic_labels(spark, sf), ordinal_tox.ToxicityConfig())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = set()
        word = ""
        for ch in texts[r["doc_id"]].lower() + " ":
            if ch.isalnum() or ch == "_":
                word += ch
            elif word:
                words.add(word)
                word = ""
        score = sum(w for f, w in model.weights.items() if f in words or "-" in f and plainly(f, words))
        p = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(p), abs=1e-9) and r["grade"] == sum(x >= 0.5 for x in p) and r["toxic"] == (p[0] >= 0.5)


def plainly(feature, words):
    head, _, least = feature.partition("-")
    return sum(w.startswith(head) and len(w) > len(head) for w in words) >= int(least or 1)
