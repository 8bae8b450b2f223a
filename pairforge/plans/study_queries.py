"""Queries of suites, probes' decisions and qualification, saved artifacts and whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.functions import text
from pairforge.operators import checks, design, incremental, probes, qualify, ranking, requests, resampling, suite, validate
from pairforge.plans import bundle, curation
from pairforge.plans.fixture import OBS_SQL, observations, pair_bank
from pairforge.plans.queries import ORACLE_SQL, _BANK, _COMPONENTS, _JUDGED, _REJECTED, _SPECS, _STUDIES, _labelled, _rejected, query, rounded, studies
from pairforge.shared import materialize, scratch, table
from pairforge.sources import artifacts, files


def _saved(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("study_id"), F.col("o_orderkey").alias("trial_id"), "o_orderpriority")
    status = F.when(F.col("o_orderpriority") < "2", "failed").otherwise("completed")
    return orders.withColumn("terminal_status", status).drop("o_orderpriority"), orders.where("o_orderpriority < '4'").drop("o_orderpriority")


_KEPT = "CASE WHEN excluded = 0 {} THEN 1 ELSE 0 END::BIGINT"
_SUMMARIES = (
    f"{OBS_SQL}, {_STUDIES}, {_REJECTED}, {_JUDGED}, summaries AS (SELECT study_id, assistant, 2 AS cells, 4::BIGINT AS trials, excluded AS excluded_comparisons, 4 * excluded AS excluded_trials, {_KEPT.format('')} AS trace_cache_hits,"
    f" {_KEPT.format('AND o_orderpriority < ' + repr('2'))} AS failed_trials, {_KEPT.format('AND o_orderpriority < ' + repr('4'))} AS judgment_cache_hits, 2 * {_KEPT.format('AND o_orderpriority < ' + repr('4'))} AS observations"
    " FROM judged JOIN orders ON study_id = CAST(o_orderkey AS VARCHAR))"
)


@query(f"WITH {_SUMMARIES} SELECT * FROM summaries")
def study_summaries(spark, sf_dir):
    return suite.study_summaries(studies(spark, sf_dir), _rejected(spark, sf_dir), *_saved(spark, sf_dir))


@query(f"WITH {_SUMMARIES} SELECT assistant, count(*) AS studies, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("trials", "excluded_comparisons", "excluded_trials", "observations", "failed_trials")) + " FROM summaries GROUP BY assistant")
def collection_summary(spark, sf_dir):
    return suite.collection_summary(study_summaries(spark, sf_dir))


_SIDES = "s AS (SELECT assistant, i1 AS i, f1 AS f, c1 AS c, a1 AS a FROM studies UNION SELECT assistant, i2, f2, c2, a2 FROM studies)"


@query(f"WITH {OBS_SQL}, {_STUDIES}, {_SIDES} SELECT assistant, any_value(n) AS studies, count(*) AS unique_inputs, count(*) AS model_authored_inputs, count(*) AS message_requests, 4 * any_value(n) AS probe_requests FROM s JOIN (SELECT assistant, count(*) AS n FROM studies GROUP BY assistant) USING (assistant) GROUP BY assistant")
def work_counts(spark, sf_dir):
    return suite.work_counts(studies(spark, sf_dir))


@query(
    f"WITH {OBS_SQL}, {_STUDIES}, {_SIDES}, g AS (SELECT assistant, count(*) AS n, count(DISTINCT (i1, f1, c1, a1, i2, f2, c2, a2)) AS d FROM studies GROUP BY assistant), u AS (SELECT assistant, list_distinct(list(f)) AS f, count_if(a NOT IN ('Brand#11', 'Brand#12')) AS strangers FROM s GROUP BY assistant)"
    " SELECT assistant, unnest(list_filter([CASE WHEN n > 32 THEN 'too many studies' END, CASE WHEN d < n THEN 'repeated studies' END, 'more than one rollout', CASE WHEN strangers > 0 THEN 'author not selected' END, 'missing framing', CASE WHEN list_contains(f, 'R') THEN 'unknown framing' END], lambda x: x IS NOT NULL)) AS problem FROM g JOIN u USING (assistant)"
)
def suite_violations(spark, sf_dir):
    """The fixture as one suite of each assistant, of which N, A and one more framing are asked."""
    return suite.suite_violations(studies(spark, sf_dir), ["Brand#11", "Brand#12"], suite.SuiteRules(framings=("A", "N", "X")))


_PAIR_OF = "regexp_replace({}, '/(first|second)$', '')"


@query(f"WITH {OBS_SQL}, {_STUDIES}, p AS (SELECT study_id, {_PAIR_OF.format('i1')} AS p FROM studies) SELECT study_id, CASE WHEN p < '4' THEN p END AS pair_id, CASE WHEN p >= '4' THEN 'unknown instruction' END AS problem FROM p")
def pair_of_study(spark, sf_dir):
    return suite.pair_of_study(studies(spark, sf_dir), pair_bank(spark, sf_dir).where("pair_id < '4'"))


@query(f"WITH {OBS_SQL} SELECT trial_id, position, instruction, pair_id FROM obs")
def rows_with_pair_ids(spark, sf_dir):
    return suite.with_pair_ids(observations(spark, sf_dir).select("trial_id", "position", "instruction"), pair_bank(spark, sf_dir))


@query("SELECT o_orderkey, o_orderstatus AS baseline_state, CASE WHEN o_orderpriority < '2' THEN 'F' ELSE o_orderstatus END AS candidate_state, o_orderpriority < '2' AND o_orderstatus <> 'F' AS changed FROM orders")
def compared_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("state"))
    other = rows.withColumn("state", F.when(F.col("o_orderpriority") < "2", "F").otherwise(F.col("state")))
    return suite.compare_runs(rows, other, ["o_orderkey"], ["state"])


def _contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("trial_id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("permutation"), "o_orderstatus", F.col("o_orderpriority").alias("setup"))
    planned = rows.where("study_id % 3 = 0").select("study_id", "permutation", F.lit("planned").alias("setup")).distinct()
    return suite.contexts_to_score(rows, rows.where("o_orderstatus = 'F'").select("trial_id", "setup"), planned)


_CONTEXTS = "x AS (SELECT o_custkey AS study_id, o_orderkey AS trial_id, CAST(o_orderkey % 2 + 1 AS INTEGER) AS permutation, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_custkey % 3 = 0 THEN 'planned' END AS setup, CASE WHEN o_orderstatus = 'F' THEN 'saved' WHEN o_custkey % 3 = 0 THEN 'scheduled' ELSE 'missing' END AS origin FROM orders)"


@query(f"WITH {_CONTEXTS} SELECT * FROM x")
def contexts_to_score(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query(f"WITH {_CONTEXTS} SELECT study_id, permutation, CASE WHEN count(DISTINCT setup) = 1 THEN min(setup) END AS setup, CASE count(DISTINCT setup) WHEN 0 THEN 'missing' WHEN 1 THEN 'available' ELSE 'conflicting' END AS state FROM x GROUP BY ALL")
def context_requests(spark, sf_dir):
    return suite.context_requests(_contexts(spark, sf_dir))


@query("SELECT conv_id || '-' || turn AS id, length(text) AS n FROM conversations WHERE role = 'assistant'")
def native_dialogues(spark, sf_dir):
    """Conversations as dialogues and their frozen partition, written as JSON lines and read back checked."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("role") == "assistant", "cal").otherwise("test").alias("split"), F.col("text").alias("text"))
    paths = [scratch(spark, "dialogues") for _ in range(2)]
    files.write_jsonl(rows.withColumn("response", F.lit("")), paths[0])
    files.write_jsonl(rows.select("id", "split", suite.normalized_hash(F.col("text")).alias("sha256")), paths[1])
    return artifacts.load_dialogues(spark, *paths, "cal").select("id", F.length("text").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN ok THEN p_size % 2 = 0 END AS feasible, CASE WHEN ok THEN CAST(p_size % 4 + 1 AS INTEGER) END AS difficulty, CASE WHEN ok THEN p_size > 10 END AS mutually_exclusive, CASE WHEN ok THEN CAST(p_size % 2 AS BIGINT) END AS issues FROM (SELECT *, p_size % 7 <> 0 AND p_size % 11 <> 0 AS ok FROM part)")
def pair_audits(spark, sf_dir):
    """Audits that are exact are read; others (a difficulty of 9, a word for a boolean) are null."""
    size = F.col("p_size")
    side = lambda feasible, level: F.struct(feasible.alias("feasible"), F.lit(True).alias("requires_tools"), level.alias("difficulty"))
    first, second = side(size % 2 == 0, size % 5 + 1), side(F.lit(True), F.when(size % 7 == 0, 9).otherwise(size % 4 + 1))
    issues = F.when(size % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    whole = lambda exclusive: F.to_json(F.struct(first.alias("first"), second.alias("second"), exclusive.alias("mutually_exclusive"), issues.alias("issues")))
    content = F.when(size % 11 == 0, whole(F.lit("yes"))).otherwise(whole(size > 10))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.pair_audit(content).alias("a"))
    return rows.select("p_partkey", F.col("a.first.feasible").alias("feasible"), F.col("a.second.difficulty").alias("difficulty"), F.col("a.mutually_exclusive").alias("mutually_exclusive"), F.size("a.issues").cast("long").alias("issues"))


@query("""SELECT o_orderkey, sha256('{"id":"' || o_orderkey || '","model":"m/x","n":' || o_custkey || '}') AS fingerprint FROM orders""")
def response_fingerprints(spark, sf_dir):
    """Routes of one model have one fingerprint."""
    model = F.when(F.col("o_orderkey") % 2 == 0, "m/x:free").otherwise("m/x")
    payload = F.to_json(F.struct(F.col("o_custkey").alias("n"), F.col("o_orderkey").cast("string").alias("id"), model.alias("model")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.response_fingerprint(payload).alias("fingerprint"))


@query()
def tool_call_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "P", "Qwen3.8 2.4T").otherwise(F.col("o_orderstatus"))
    return orders.select("o_orderkey", text.tool_call_id(name, F.col("o_orderkey").cast("string")).alias("call_id"))


def _decided(spark, sf_dir):
    p = F.col("n_chars") / (F.col("n_chars") + 1500.0)
    kind = F.when(F.col("source").endswith("a"), "descriptive").when(F.col("quality") == 1, "reasoning").otherwise("nonreasoning")
    rows = _labelled(spark, sf_dir).select("doc_id", kind.alias("expectation"), F.col("lang").alias("channel"), p.alias("probability"), "source", "n_chars", "toxic")
    thresholds = spark.createDataFrame([("de", 0.6, 0.3), ("fr", 0.2, 0.7)], "channel string, reasoning_minimum double, nonreasoning_maximum double")
    return probes.decide(rows, 0.5, thresholds)


_DECIDED = (
    "k AS (SELECT *, CASE WHEN source LIKE '%a' THEN 'descriptive' WHEN quality = 1 THEN 'reasoning' ELSE 'nonreasoning' END AS expectation, n_chars / (n_chars + 1500.0::DOUBLE) AS p, CASE lang WHEN 'de' THEN 0.6 WHEN 'fr' THEN 0.2 ELSE 0.5 END::DOUBLE AS lo, CASE lang WHEN 'de' THEN 0.3 WHEN 'fr' THEN 0.7 ELSE 0.5 END::DOUBLE AS hi FROM labels JOIN documents USING (doc_id)),"
    " d AS (SELECT *, CASE expectation WHEN 'reasoning' THEN p >= lo WHEN 'nonreasoning' THEN p < hi END AS complies FROM k)"
)


@query(f"WITH {_DECIDED} SELECT doc_id, expectation, complies, CASE WHEN NOT complies THEN 'mean probability ' || printf('%.8f', p) || ' conflicts with ' || expectation || ' at threshold ' || printf('%.8f', CASE expectation WHEN 'reasoning' THEN lo ELSE hi END) END AS issue FROM d")
def probe_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "expectation", "complies", "issue")


@query(f"WITH {_DECIDED}, u AS (SELECT 'channel' AS axis, lang AS value, * FROM d UNION ALL SELECT 'expectation', expectation, * FROM d) SELECT axis, value, count_if(toxic = 0)::BIGINT AS scores, count_if(toxic = 0 AND complies IS NOT NULL)::BIGINT AS directional, count_if(toxic = 0 AND NOT complies)::BIGINT AS mismatches, count_if(toxic = 1)::BIGINT AS errors, CAST(sum(n_chars % 5) AS BIGINT) AS masked FROM u GROUP BY ALL")
def probe_reports(spark, sf_dir):
    rows = _decided(spark, sf_dir).select("channel", "expectation", F.when(F.col("toxic") == 0, F.col("complies")).alias("complies"), F.when(F.col("toxic") == 1, "failed").alias("error"), (F.col("n_chars") % 5).alias("masked"))
    return probes.probe_reports(rows.withColumn("complies", F.col("complies")), ("channel", "expectation"))


@query("WITH d AS (SELECT quality AS label, source, count(*) AS n, count_if(quality = CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS k FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT label, round(sum(k) / sum(n), 9) AS accuracy, round(avg(CAST(k AS DOUBLE) / n), 9) AS document_accuracy FROM d GROUP BY label")
def role_accuracies(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select(F.col("source").alias("document"), F.col("quality").alias("label"), (F.col("n_chars") >= 1000).cast("int").alias("predicted"))
    return rounded(probes.role_accuracies(rows))


def _scores(spark, sf_dir, first: bool):
    rows = _labelled(spark, sf_dir).where(F.col("lang").isin("en", "de") == F.lit(first))
    return rows.select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))


@query(
    "WITH a AS (SELECT n_chars AS s, quality = 1 AS pos, lang IN ('en', 'de') AS cal FROM labels JOIN documents USING (doc_id)), r AS (SELECT * FROM a WHERE cal), t AS (SELECT DISTINCT s FROM r),"
    " c AS (SELECT t.s, count_if(pos AND r.s >= t.s) / CAST(count_if(pos) AS DOUBLE) AS x, count_if(NOT pos AND r.s < t.s) / CAST(count_if(NOT pos) AS DOUBLE) AS y, count_if(r.s >= t.s) AS up, count(*) AS n FROM t, r GROUP BY t.s),"
    " b AS (SELECT s FROM c WHERE up < n AND up > 0 AND (SELECT avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END::DOUBLE) FROM r p, r q WHERE p.pos AND NOT q.pos) > 0.5 ORDER BY (x + y) / 2 DESC, least(x, y) DESC, s DESC LIMIT 1)"
    " SELECT round(count_if(pos AND a.s >= b.s) / nullif(CAST(count_if(pos) AS DOUBLE), 0), 9) AS test_sensitivity, round(count_if(NOT pos AND a.s < b.s) / nullif(CAST(count_if(NOT pos) AS DOUBLE), 0), 9) AS test_specificity FROM a LEFT JOIN b ON true WHERE NOT cal"
)
def frozen_threshold(spark, sf_dir):
    """A threshold chosen on two languages, held against the others."""
    return rounded(probes.rates_at(_scores(spark, sf_dir, False), probes.threshold_calibration(_scores(spark, sf_dir, True))))


def _nations(spark, sf_dir):
    """Nations as conversations: their suppliers' greatest and mean balance as the scores of two segments."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("conversation")).agg(F.max("s_acctbal").alias("hi"), F.avg("s_acctbal").alias("mid"))
    share = lambda c: F.greatest(F.lit(0.0), F.col(c).cast("double")) / 20_000.0
    return s.select("conversation", share("hi").alias("reasoning"), share("mid").alias("final"))


@query()
def bootstrap_auc(spark, sf_dir):
    return rounded(resampling.paired_bootstrap(_nations(spark, sf_dir)))


@query()
def probe_qualification(spark, sf_dir):
    """Frozen on the first nations, tested on the others, with the documents' labels as tokens."""
    pairs, p = _nations(spark, sf_dir), F.col("n_chars") / (F.col("n_chars") + 1000.0)
    tokens = _labelled(spark, sf_dir).select(F.col("source").alias("document"), F.col("quality").alias("label"), (F.col("n_chars") >= 1000).cast("int").alias("predicted"), p.alias("p"))
    return rounded(qualify.qualification(pairs.where("conversation < 12"), pairs.where("conversation >= 12"), tokens))


def _word_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"([^ \n]+)"), 1)).alias("position", "token"))


@query("WITH w AS (SELECT doc_id AS document, regexp_extract_all(text, '[^ \\n]+') AS words FROM documents), f AS (SELECT document, min(document) OVER (PARTITION BY words) AS original, len(words) AS tokens FROM w) SELECT document, original, tokens FROM f WHERE document <> original")
def copied_documents(spark, sf_dir):
    """Documents that hold another one's words under an id of their own, whatever stands between the words."""
    marks, _ = materialize(spark, qualify.content_signatures(_word_tokens(spark, sf_dir)), "signatures")
    first = marks.groupBy("signature").agg(F.min("document").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return marks.join(first, "signature").where("document <> original").select("document", "original", "tokens")


@query("WITH w AS (SELECT 'p' || (doc_id % 4) AS part, regexp_extract_all(text, '[^ \\n]+') AS words FROM documents), d AS (SELECT words, list_sort(list(DISTINCT part)) AS parts FROM w GROUP BY words) SELECT parts[1] AS first_part, len(parts) AS parts, count(*) AS contents FROM d WHERE len(parts) > 1 GROUP BY ALL")
def shared_content(spark, sf_dir):
    """Content that more than one of four parts of the documents holds, counted by the first of them."""
    tokens = _word_tokens(spark, sf_dir).withColumn("part", F.concat(F.lit("p"), F.col("document") % 4))
    marks, _ = materialize(spark, qualify.content_signatures(tokens, ("part", "document")), "signatures")
    found = qualify.shared_content({x: marks.where(F.col("part") == x) for x in ("p0", "p1", "p2", "p3")})
    return found.groupBy(F.element_at("parts", 1).alias("first_part"), F.size("parts").cast("long").alias("parts")).agg(F.count(F.lit(1)).alias("contents"))


@query(f"WITH RECURSIVE {OBS_SQL}, {_COMPONENTS} SELECT component, 0.0::DOUBLE AS largest_gradient, 0.0::DOUBLE AS mean_score, count(*) AS cells FROM c GROUP BY component")
def bt_stationarity(spark, sf_dir):
    """The fit's own conditions, computed from the comparisons: no gradient is left and scores are centred."""
    obs, _ = materialize(spark, observations(spark, sf_dir), "observations")
    out = ranking.stationarity(obs, ranking.fit_all(obs, penalties=(1.0,)))
    tidy = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return out.select("component", tidy("largest_gradient"), F.abs(F.round("mean_score", 6)).alias("mean_score"), "cells")


@query(f"WITH {_SPECS}, x AS (SELECT * FROM specs WHERE pair_id < '4' UNION ALL SELECT * FROM specs WHERE pair_id < '2' UNION ALL SELECT * FROM specs WHERE pair_id LIKE '4%' AND side = 'first' AND channel <> 'user message') SELECT DISTINCT pair_id, 'repeated' AS problem FROM x WHERE pair_id < '2' UNION SELECT DISTINCT pair_id, unnest(['missing side', 'no user channel']) FROM x WHERE pair_id LIKE '4%'")
def side_violations(spark, sf_dir):
    """One pair twice, one without its second side and without the user's channel."""
    specs = design.pair_specs(pair_bank(spark, sf_dir))
    rows = specs.where("pair_id < '4'").unionByName(specs.where("pair_id < '2'")).unionByName(specs.where("pair_id LIKE '4%' AND side = 'first' AND channel <> 'user message'"))
    return validate.side_violations(rows)


@query("SELECT vec_id, i - 1 AS layer, round(list_sum(list_transform(embedding[32 * i - 31 : 32 * i], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings, (VALUES (1), (2)) t(i)")
def activations_round_trip(spark, sf_dir):
    """Vectors saved as shards of two layers with rows and a manifest of digests, and loaded again."""
    folder = scratch(spark, "activations")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("document"), F.lit("reasoning").alias("role"), F.lit(0).cast("long").alias("position"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("layers"))
    artifacts.save_activations(rows, folder)
    loaded = artifacts.load_activations(spark, folder)
    total = F.aggregate("activation", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return loaded.select(F.col("document").cast("long").alias("vec_id"), "layer", (F.round(total, 4) + 0.0).alias("total"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS study_id, 1 AS permutation, 1 AS position, o_custkey / (o_custkey + 500.0::DOUBLE) >= 0.5 AS complies FROM orders WHERE o_custkey IS NOT NULL")
def verdict_cache(spark, sf_dir):
    """Verdicts saved, replaced, and decided again when they are read."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("study_id"), F.lit(1).alias("permutation"), F.lit(1).alias("position"), F.lit("reasoning").alias("expectation"), F.lit("c").alias("channel"), (F.col("o_custkey") / (F.col("o_custkey") + 500.0)).alias("probability"))
    cache = artifacts.VerdictCache(spark, scratch(spark, "verdicts"), 0.5)
    cache.put(rows.withColumn("probability", F.lit(0.0)))
    cache.put(rows)
    return cache.read().select("study_id", "permutation", "position", "complies")


@query(f"WITH {_BANK} SELECT pair_id AS folder, side AS name, length(instruction) AS n FROM sides")
def paired_texts(spark, sf_dir):
    """A text for every side of every pair, exactly."""
    sides = pair_bank(spark, sf_dir).select(F.col("pair_id").alias("folder"), F.expr("stack(2, 'first', first, 'second', second) as (name, content)"))
    return artifacts.paired_texts(sides, sides.select("folder", "name")).select("folder", "name", F.length("content").cast("long").alias("n"))


@query()
def analysis_bundle(spark, sf_dir):
    """Rows of every table of a whole analysis, from one observation table."""
    out = bundle.analyse(observations(spark, sf_dir), pair_bank(spark, sf_dir))
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in out.tables.items()]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


@query(
    f"WITH RECURSIVE {OBS_SQL}, {_COMPONENTS}, t AS (SELECT trial_id, count_if(completed) AS k FROM obs GROUP BY trial_id), places AS (SELECT cell_id, position, count(*) AS n FROM obs GROUP BY ALL), b AS (SELECT min(n) = max(n) AND min(position) = 1 AND max(position) = count(*) AS balanced FROM places GROUP BY cell_id), g AS (SELECT DISTINCT component, pair_id, assistant FROM obs JOIN c USING (cell_id))"
    " SELECT (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM t) AS trials, (SELECT count(*) FROM c) AS cells, (SELECT count(*) FROM t) AS comparison_count, (SELECT count_if(k <> 1)::BIGINT FROM t) AS tie_comparisons, (SELECT count(DISTINCT component) FROM c) AS components, (SELECT count(DISTINCT component) = 1 FROM c) AS comparison_graph_connected,"
    " (SELECT count(*) = count(DISTINCT component) AND count(DISTINCT (pair_id, assistant)) = count(DISTINCT component) FROM g) AS components_match_pair_assistant, (SELECT count_if(k = 2)::BIGINT FROM t) AS both_completed_trials, (SELECT count_if(k = 0)::BIGINT FROM t) AS neither_completed_trials, (SELECT bool_and(balanced) FROM b) AS position_balanced, (SELECT count_if(NOT balanced)::BIGINT FROM b) AS unbalanced_cells, true AS fit_converged"
)
def analysis_diagnostics(spark, sf_dir):
    """The checks of an analysis that SQL can count, and that the fit converged."""
    found = bundle.analyse(observations(spark, sf_dir), pair_bank(spark, sf_dir), bundle.AnalysisConfig(bootstrap=False, lasso=None)).diagnostics
    return found.drop("fit_iterations", "fit_objective", "least_rank_correlation", "greatest_rank_shift")


def _followed(spark, sf_dir):
    """Stored counts after three batches: some trials come first with other outcomes, and are replaced by what they are."""
    obs, _ = materialize(spark, observations(spark, sf_dir), "observations")
    followed = incremental.IncrementalReports(spark, scratch(spark, "followed"), buckets=8)
    early = obs.where("trial_id % 3 = 0").withColumn("completed", F.when(F.col("trial_id") % 2 == 0, ~F.col("completed")).otherwise(F.col("completed")))
    for batch in (early, obs.where("trial_id % 3 = 1"), obs.where("trial_id % 3 = 2 OR trial_id % 2 = 0")):
        followed.add(batch)
    return followed


@query(ORACLE_SQL["axis_summary"])
def followed_axis_summary(spark, sf_dir):
    return rounded(_followed(spark, sf_dir).reports()["axis_summary"])


@query(ORACLE_SQL["pair_exclusivity"])
def followed_pair_exclusivity(spark, sf_dir):
    return rounded(_followed(spark, sf_dir).reports()["pair_exclusivity"])


_RULES_SQL = " UNION ALL ".join(f"SELECT '{name}' AS rule, sale_id FROM sales WHERE {sql}" for name, sql in (("no client", "client_id IS NULL"), ("no status", "status IS NULL"), ("arrived late", "arrived_at > sold_at + INTERVAL 1 HOUR"), ("no priority", "priority IS NULL")))


@query(_RULES_SQL)
def broken_rules(spark, sf_dir):
    """Rows of sales that break rules, one row a rule, from one scan."""
    rules = [checks.Rule("no client", F.col("client_id").isNull()), checks.Rule("no status", F.col("status").isNull()), checks.Rule("arrived late", F.col("arrived_at") > F.col("sold_at") + F.expr("INTERVAL 1 HOUR")), checks.Rule("no priority", F.col("priority").isNull())]
    return checks.violations(table(spark, sf_dir, "sales"), rules, "sale_id")


def _measured(spark, sf_dir):
    """Requests of the fixture's studies, their scores and issues: some are missing, in error, classified twice or not at all."""
    planned, _ = materialize(spark, design.probe_requests(studies(spark, sf_dir)), "requests")
    h = (F.col("study_id").cast("long") * 3 + F.col("permutation") * 2 + F.col("position")) % 11
    coordinate = planned.select("study_id", "permutation", "position", h.alias("h"))
    complies = F.when(F.col("h") % 3 > 0, F.col("h") % 3 == 1)
    mark = F.when(F.col("study_id").cast("long") % 50 == 0, F.lit("same")).otherwise(F.concat_ws("/", "study_id", "permutation", "position"))
    scores = coordinate.where("h > 2").select("study_id", "permutation", "position", mark.alias("context_fingerprint"), complies.alias("complies"), F.col("h").alias("masked"))
    issues = coordinate.where("h IN (0, 1, 10)").select("study_id", "permutation", "position", F.when(F.col("h") == 0, "missing").otherwise("error").alias("kind"), F.concat(F.lit("reason "), "h").alias("reason"))
    return planned, scores, issues


_MEASURED = (
    f"{OBS_SQL}, {_STUDIES}, c AS (SELECT study_id, assistant, CAST(p AS INTEGER) AS permutation, CAST(q AS INTEGER) AS position, (CAST(study_id AS BIGINT) * 3 + p * 2 + q) % 11 AS h FROM studies, (VALUES (1), (2)) x(p), (VALUES (1), (2)) y(q)),"
    " o AS (SELECT *, 'score' AS outcome FROM c WHERE h > 2 UNION ALL SELECT *, CASE h WHEN 0 THEN 'missing' ELSE 'error' END FROM c WHERE h IN (0, 1, 10) UNION ALL SELECT *, 'unclassified' FROM c WHERE h = 2)"
)


@query(f"WITH {_MEASURED} SELECT study_id, permutation, position, outcome, CASE WHEN outcome = 'score' AND h % 3 > 0 THEN h % 3 = 1 END AS complies, CASE WHEN outcome IN ('missing', 'error') THEN 'reason ' || h END AS reason FROM o")
def request_outcomes(spark, sf_dir):
    return requests.request_outcomes(*_measured(spark, sf_dir)).select("study_id", "permutation", "position", "outcome", "complies", "reason")


@query(f"WITH {_MEASURED} SELECT 'not classified' AS rule, study_id, permutation, position FROM c WHERE h = 2 UNION ALL SELECT 'classified twice', study_id, permutation, position FROM c WHERE h = 10 UNION ALL SELECT 'contexts alike', study_id, NULL, NULL FROM o WHERE outcome = 'score' AND CAST(study_id AS BIGINT) % 50 = 0 GROUP BY study_id HAVING count(*) > 1")
def request_violations(spark, sf_dir):
    return requests.request_violations(*_measured(spark, sf_dir))


@query(
    f"WITH {_MEASURED} SELECT count(DISTINCT (study_id, permutation, position)) AS planned_requests, count_if(outcome = 'score')::BIGINT AS scores, count_if(outcome = 'score' AND h % 3 > 0)::BIGINT AS directional_scores, count_if(outcome = 'score' AND h % 3 = 0)::BIGINT AS descriptive_scores,"
    " count_if(outcome = 'score' AND h % 3 = 2)::BIGINT AS reference_mismatches, count_if(outcome = 'missing')::BIGINT AS missing_requests, count_if(outcome = 'error')::BIGINT AS error_requests, round(count_if(outcome = 'score') / CAST(count(DISTINCT (study_id, permutation, position)) AS DOUBLE), 9) AS coverage, CAST(sum(CASE WHEN outcome = 'score' THEN h ELSE 0 END) AS BIGINT) AS masked_boundary_tokens FROM o"
)
def request_counts(spark, sf_dir):
    return rounded(requests.request_counts(requests.request_outcomes(*_measured(spark, sf_dir))))


def _item_bank(spark, sf_dir):
    """Items as pairs of a bank, and checks of them: some of another definition, some with issues, some missing."""
    i = table(spark, sf_dir, "items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("kind").alias("kind"), F.min("brand").alias("brand"), F.min("size").alias("size"))
    bank = i.select(F.concat(F.lit("item-"), "item_id").alias("pair_id"), F.coalesce("kind", F.lit("none")).alias("skill"), F.coalesce("brand", F.lit("none")).alias("conflict"), F.lit("a").alias("first"), F.lit("b").alias("second"), F.lit("r").alias("rationale"), "item_id")
    n = F.col("item_id")
    checks = bank.where(n % 5 != 0).withColumns({"first_feasible": n % 7 != 0, "second_feasible": F.lit(True), "first_difficulty": (n % 6).cast("int"), "second_difficulty": F.lit(3), "requires_tools": n % 11 != 0, "mutually_exclusive": F.lit(True), "issues": F.when(n % 2 == 0, F.array(F.lit("note")))})
    return bank.drop("item_id"), checks.withColumn("second", F.when(n % 13 == 0, "changed").otherwise(F.col("second"))).drop("item_id")


@query(
    "WITH i AS (SELECT item_id AS n, coalesce(min(kind), 'none') AS skill, coalesce(min(brand), 'none') AS conflict FROM items WHERE item_id IS NOT NULL GROUP BY item_id), c AS (SELECT *, n % 5 <> 0 AND n % 13 <> 0 AS checked, list_filter([CASE WHEN n % 7 = 0 THEN 'first instruction is not feasible' END, CASE WHEN n % 6 NOT BETWEEN 2 AND 4 THEN 'first instruction difficulty ' || (n % 6) END, CASE WHEN n % 11 = 0 THEN 'neither instruction requires tools' END], lambda x: x IS NOT NULL) AS reasons FROM i)"
    " SELECT 'item-' || n AS pair_id, skill, conflict, CASE WHEN NOT checked THEN 'not audited' WHEN len(reasons) = 0 THEN 'pass' ELSE 'FAIL' END AS verdict, CASE WHEN checked THEN (n % 6) || ' / 3' ELSE '' END AS difficulty, CASE WHEN checked THEN array_to_string(list_concat(reasons, CASE WHEN n % 2 = 0 THEN ['note'] ELSE [] END), '; ') ELSE '' END AS reasons FROM c"
)
def curation_audit(spark, sf_dir):
    """Verdicts on every pair of a bank; a check of another definition does not count."""
    return curation.audit(*_item_bank(spark, sf_dir))


@query(
    "WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run, source AS pair_id, lang AS judge, CASE WHEN toxic = 0 THEN quality = 1 END AS complies FROM labels JOIN documents USING (doc_id)),"
    " g AS (SELECT pair_id, judge, " + ", ".join(f"count_if(run = '{run}' AND complies IS NOT NULL AND complies) AS {run}_p, count_if(run = '{run}' AND complies IS NOT NULL) AS {run}_n" for run in ("baseline", "candidate")) + " FROM r GROUP BY ALL),"
    " a AS (SELECT * FROM g UNION ALL SELECT 'Overall', judge, sum(baseline_p), sum(baseline_n), sum(candidate_p), sum(candidate_n) FROM g GROUP BY judge)"
    " SELECT pair_id, judge, " + ", ".join(f"{run}_p || '/' || {run}_n || ' (' || CASE WHEN {run}_n = 0 THEN 'N/A' ELSE format('{{:.1f}}', 100.0::DOUBLE * {run}_p / {run}_n) || '%' END || ')' AS {run}" for run in ("baseline", "candidate")) + " FROM a"
)
def run_comparison(spark, sf_dir):
    """Two runs' passes by pair and judge, and overall."""
    run = F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("candidate")
    rows = _labelled(spark, sf_dir).select(run.alias("run"), F.col("source").alias("pair_id"), F.col("lang").alias("judge"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("complies"))
    return curation.run_comparison(rows)
