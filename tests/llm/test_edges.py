"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from pairforge.llm import audio, bpe_reuse, hostrep, order_minhash, ordinal_tox, packing, ppm, secrets, topk, warc_index
from pairforge.shared import literal

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(40_000))
ROWS = [(1, "Some words of a text, not long."), (2, None), (3, ""), (None, "no id here at all, but text"), (4, LONG), (1, "Some words of a text, not long."), (5, "Some words of a text, not long."), (6, " \n\t "), (7, "é ü 日本 😀"), (8, "x" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, "b", 3.0, "c", True, None) for i, t in ROWS]
    df = literal(spark, rows, "doc_id long, text string, id string, node int, n int, block string, key double, label string, held_out boolean, words string")
    return df.repartition(3)


OPERATORS = {
    "audio": lambda df: audio.audio_features(df, digests=True),
    "audio_full": lambda df: audio.audio_features(df),
    "bpe": lambda df: bpe_reuse.bpe_round_trip(df, digests=True),
    "bpe_full": lambda df: bpe_reuse.bpe_round_trip(df),
    "secrets": secrets.secret_spans,
    "redact": secrets.redact_secrets,
    "near": order_minhash.near_duplicates,
    "ppm": lambda df: ppm.score_documents(df, ppm.held_out_tenth),
    "toxicity": lambda df: ordinal_tox.toxicity(df, ordinal_tox.OrdinalModel({"words": 2.0}, (1.0, 3.0))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(docs, name):
    out = OPERATORS[name](docs).collect()
    assert len(out) == len(ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.where("false")).collect() == []


def test_equal_texts_have_equal_values(docs):
    for name in ("audio", "bpe", "secrets"):
        by_text = {}
        for r in OPERATORS[name](docs).collect():
            if r["doc_id"] in (1, 5):
                by_text.setdefault("same", set()).add(tuple(r)[1:])
        assert len(by_text["same"]) == 1


def test_packing_covers_every_id_once(docs):
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    assert packing.pack_documents(docs.where("false")).count() == 0
    assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS}
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 4)
    assert next(r for r in rows if r["doc_id"] == 3)["ids"] == [1]


def test_near_classes_of_edges(docs):
    got = {(r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(docs).collect()}
    assert {(1, 1), (5, 1), (2, 2), (3, 2), (6, 6), (None, None), (4, 4)} <= got
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_one_is_kept_whatever_columns_are_named(docs):
    """Names that helpers use, here or in earlier versions, as columns of the table."""
    names = ["_first_id", "_first_none", "_first_h1", "_first_h2", "key", "row", "h1", "h2", "id", "none", "node", "label", "class_id", "leader", "mask", "a", "b"]
    more = docs.withColumns({n: F.lit(n) for n in names})
    kept = order_minhash.keep_one(more)
    assert kept.columns == more.columns
    rows = kept.collect()
    assert len(rows) == 7 and all(r[n] == n for r in rows for n in names)


def test_filters_keep_columns(docs):
    model = ordinal_tox.OrdinalModel({"words": 5.0}, (1.0,))
    out = ordinal_tox.drop_toxic(docs, model)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {2, 3, 4, 6, 7, 8, None}
    assert ordinal_tox.drop_toxic(docs, ordinal_tox.OrdinalModel()).count() == len(ROWS)


def test_pages(spark):
    rows = [(1, "http://a.com/x", "<p>", 0), (2, None, None, 0), (3, "nothing", "", 0), (None, "http://A.com/x#y", "<p>", 0), (1, "http://a.com/x", "<p>", 0), (4, "http://b.co.uk:80/\r\nx y", "z" * 100_000, 0)]
    pages = literal(spark, rows, "page_id long, url string, html string, payload int").withColumn("digest", F.lit(1)).withColumn("host", F.lit(2))
    got = warc_index.archive_and_index(pages).collect()
    assert len(got) == len(rows)
    assert [r["payload_bytes"] for r in got if r["page_id"] in (2, 3)] == [0, 0]
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "response", None), (2, "response", None), (3, "revisit", 2), (None, "revisit", 1), (4, "response", None)}
    assert warc_index.archive_and_index(pages.where("false")).count() == 0
    outcomes = literal(spark, [(1, True), (1, None), (None, True), (9, False)], "id long, bad boolean")
    out = hostrep.filter_urls(pages, outcomes, hostrep.RULES)
    assert {(r["page_id"], r["host"], r["path"]) for r in out.collect()} == {(1, "a.com", "/x"), (2, "", ""), (3, "", ""), (None, "a.com", "/x"), (4, "b.co.uk:80", "/\r\nx y")}
    assert out.count() == len(rows) and hostrep.filter_urls(pages.where("false"), outcomes).count() == 0
    assert hostrep.filter_urls(pages, outcomes.where("false")).where("verdict = 'block'").count() == 0


def test_hosts_of_all_kinds_equal_sql(spark):
    """Second levels, addresses, ports and users: the registered SQL gives the operator's rows."""
    import duckdb

    hosts = [f"{w}.{d}" for d in ("bad.co.uk", "good.co.uk", "a.com.au", "b.com.au", "x.net", "y.org.nz", "co.uk") for w in ("www", "m", "new")]
    hosts += ["10.0.2.3", "10.1.2.3:8080", "[::1]", "[2001:db8::1]:443", "me@www.bad.co.uk", "me:pw@www.x.net:81", "localhost", "A.COM.AU", ""]
    rows = [(k, f"http://{h}/{k % 3}") for k, h in enumerate(hosts * 4)]
    bad = [(k, int("good" in u or "x.net" in u or k % 7 == 0), int("10." in u and k % 2)) for k, u in rows if k % 5]
    pages, labels = literal(spark, rows, "page_id long, url string"), literal(spark, bad, "doc_id long, quality int, toxic int")
    outcomes = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    got = [tuple(r) for r in hostrep.filter_urls(pages, outcomes, hostrep.RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({hostrep.ORACLE})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {v for *_, v in got} == {"allow", "block"}


def test_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, [0.5, -0.5]), (5, [1.0]), (6, []), (20, [0.25, 0.5]), (4, [1e30, 1e30]), (21, [0.5, 0.5])]
    df = literal(spark, rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    df = df.unionByName(df.limit(1).select(F.lit(30).cast("long").alias("vec_id"), F.array(F.lit(float("nan")), F.lit(1.0)).alias("embedding"), "v", "score"))
    got = [tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 4, (1 << 63) - 1), (20, 2, 1, 16 * 32 + 32 * 32), (20, 3, 21, 16 * 32 + 32 * 32)]
    assert topk.top_k(df.where("false"), lambda i: i % 20 == 0).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    sf_dir, ids = "/root/testdata/sf0.001", lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    every = sorted((i is None, i or 0) for i, _ in ROWS)
    for name in ("toxicity", "secrets"):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and ids(out) == every
    once = stages["near_dedup"](spark, docs, sf_dir)
    assert once.columns == docs.columns and ids(once) == [(False, 1), (False, 2), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
    packed = stages["packing"](spark, docs, sf_dir)
    assert ids(packed.where("start = 0")) == every
    assert {r["doc_tokens"] for r in packed.where("doc_id in (2, 3)").collect()} == {1}
    for stage in stages.values():
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_an_id_with_many_texts_is_sampled(spark):
    rows = [(1, f"bad wordy{k % 7} number{k} of many") for k in range(300)] + [(k, f"good words, number{k}") for k in range(2, 60)]
    df = literal(spark, rows, "doc_id long, text string")
    labels = literal(spark, [(1, 1), *((k, 0) for k in range(2, 60))], "id long, grade int")
    model = ordinal_tox.fit_toxicity(df, labels, ordinal_tox.ToxicityConfig(sample=100))
    assert ordinal_tox.toxicity(df, model).where("doc_id = 1 AND severity <= 0").count() == 0


def test_domains_and_suffixes(spark):
    cases = {"a.b.co.nz": ("b.co.nz", "co.nz"), "x.com.cn:80": ("x.com.cn", "com.cn"), "www.a.com": ("a.com", "com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "[::1]:8080": ("[::1]", "[::1]"), "u@t.co": ("t.co", "co"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "a.computer.uk": ("computer.uk", "uk")}
    cfg = hostrep.ReputationConfig()
    hosts = literal(spark, [(h,) for h in cases], "host string")
    got = hosts.select("host", hostrep.domain_of(F.col("host"), cfg).alias("d"), hostrep.suffix_of(F.col("host"), cfg).alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == cases
