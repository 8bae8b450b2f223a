"""Queries of the smaller operators: readers, audits, reuse, sets, functions and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairforge.functions import stats, text
from pairforge.operators import design, observe, probes, ranking, reports, validate
from pairforge.plans.fixture import OBS_SQL, observations, pair_bank
from pairforge.plans.queries import _AXIS_U, _BANK, _CELL, _EDGES, _PAIRED, _REJECTED, _SIZES, _SPECS, _STRATA, _STUDIES, _corr_sql, _edges, _labelled, _rejected, observation_rows, order_sensitivity, query, rounded, studies
from pairforge.plans.queries import ORACLE_SQL as _SQL
from pairforge.schema import AUTHORS, CHANNELS, FRAMINGS, USER_CHANNEL, axis_dimension
from pairforge.shared import scratch, table
from pairforge.sources import buckets, files


@query(_SQL["observation_rows"])
def observations_round_trip(spark, sf_dir):
    """Written as JSON lines in two parts, compressed, read back by the strict reader. The rows' joins are stored already, so the rows are not."""
    rows = observation_rows(spark, sf_dir)
    paths = [scratch(spark, "jsonl") for _ in range(2)]
    for path, part in zip(paths, (rows.where("completed"), rows.where("NOT completed")), strict=True):
        files.write_jsonl(part, path, "gzip")
    return files.load_observations(spark, paths)


@query(_SQL["keyed_upsert"].replace("trial_id,", "CAST(o_orderkey AS VARCHAR) AS trial_id,").replace("SELECT o_orderkey AS CAST", "SELECT CAST"))
def keyed_table(spark, sf_dir):
    """Two writes of a keyed table, the second replacing rows of the first."""
    orders = table(spark, sf_dir, "orders")
    saved = buckets.KeyedTable(spark, scratch(spark, "keyed"), "trial_id string, payload string", ["trial_id"])
    saved.put(orders.select(F.col("o_orderkey").cast("string").alias("trial_id"), F.lit("old").alias("payload")))
    saved.put(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("trial_id"), F.lit("new").alias("payload")))
    return saved.read()


@query("SELECT axis, value, CAST(ordinal AS INTEGER) AS ordinal FROM (VALUES " + ", ".join(f"('{a}', '{v}', {k})" for a, values in (("framing", FRAMINGS), ("channel", CHANNELS), ("author", AUTHORS)) for k, v in enumerate(values)) + ") t(axis, value, ordinal)")
def axis_manifest(spark, sf_dir):
    return axis_dimension(spark)


@query(f"WITH {OBS_SQL}, {_AXIS_U} SELECT axis, value, {_corr_sql()} FROM u GROUP BY ALL")
def position_correlations(spark, sf_dir):
    rows = reports.unpivot(observations(spark, sf_dir), ("framing", "channel", "author"), "axis", ["position", "completed"])
    return rounded(reports.correlation_by(rows, "axis", "value"))


@query(f"SELECT kind, value, position_rate_range FROM ({_SQL['order_sensitivity']}) ORDER BY position_rate_range DESC, kind, value LIMIT 20")
def top_order_sensitivity(spark, sf_dir):
    return order_sensitivity(spark, sf_dir).orderBy(F.desc("position_rate_range"), "kind", "value").limit(20).select("kind", "value", "position_rate_range")


@query(f"WITH {OBS_SQL}, p AS (SELECT {_PAIRED}) SELECT (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT trial_id) FROM obs) AS trials, (SELECT count(DISTINCT cell_id) FROM obs) AS cells, (SELECT count(*) FROM p) AS comparison_count, (SELECT CAST(count_if(outcome = 0.5) AS BIGINT) FROM p) AS tie_comparisons")
def diagnostic_counts(spark, sf_dir):
    obs = observations(spark, sf_dir)
    rows = obs.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("trial_id").alias("trials"), F.countDistinct("cell_id").alias("cells"))
    pairs = ranking.comparisons(obs).agg(F.count(F.lit(1)).alias("comparison_count"), F.count_if(F.col("outcome") == 0.5).alias("tie_comparisons"))
    return rows.join(pairs)


@query(f"WITH {OBS_SQL} SELECT cell_id, instruction, framing, channel, author, assistant, count(*) AS observations FROM obs GROUP BY ALL")
def cells(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("cell_id", "instruction", "framing", "channel", "author", "assistant").agg(F.count(F.lit(1)).alias("observations"))


@query(f"WITH {OBS_SQL}, o AS (SELECT *, CASE WHEN cell_id < '2' AND completed THEN channel || '?' ELSE channel END AS said FROM obs) SELECT cell_id FROM o GROUP BY cell_id HAVING count(DISTINCT (instruction, framing, said, author, assistant)) > 1")
def cell_violations(spark, sf_dir):
    """An eighth of the cells names another channel where it completes; those that do and don't stand for two coordinates."""
    said = F.when((F.col("cell_id") < "2") & F.col("completed"), F.concat("channel", F.lit("?"))).otherwise(F.col("channel"))
    return validate.cell_violations(observations(spark, sf_dir).withColumn("channel", said))


@query(f"WITH {OBS_SQL}, {_STUDIES}, s AS (SELECT i1 AS instruction, f1 AS framing, c1 AS channel, a1 AS author FROM studies UNION SELECT i2, f2, c2, a2 FROM studies) SELECT * FROM s WHERE (instruction, framing, channel, author) NOT IN (SELECT (instruction, framing, channel, author) FROM obs WHERE completed AND pair_id < '3')")
def specs_to_write(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return observe.specs_to_write(studies(spark, sf_dir), obs.where("completed AND pair_id < '3'"))


@query(f"WITH {OBS_SQL}, {_STUDIES}, {_REJECTED}, s AS (SELECT i1 AS instruction, f1 AS framing, c1 AS channel, a1 AS author FROM studies UNION SELECT i2, f2, c2, a2 FROM studies), b AS (SELECT *, CAST((instruction, framing, channel, author) IN (SELECT (instruction, framing, channel, author) FROM rejected) AS BIGINT) AS bad FROM s), u AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, bad FROM b" for a in ("instruction", "framing", "channel", "author")) + ") SELECT axis, value, count(*) AS inputs, CAST(sum(bad) AS BIGINT) AS failed_inputs FROM u GROUP BY ALL")
def inputs_by_axis(spark, sf_dir):
    specs = studies(spark, sf_dir).select(F.explode(F.array("input1", "input2")).alias("s")).select("s.*")
    return observe.input_counts(specs, _rejected(spark, sf_dir))


_MESSAGES = "m AS (SELECT l_orderkey, l_returnflag AS framing, l_linestatus AS content FROM lineitem)"


def _messages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("string").alias("instruction"), F.col("l_returnflag").alias("framing"), F.lit("c").alias("channel"), F.lit("a").alias("author"), F.col("l_linestatus").alias("content"))


@query("WITH g AS (SELECT CAST(l_orderkey AS VARCHAR) AS instruction, l_returnflag AS framing, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY ALL) SELECT instruction, framing, CASE WHEN lo <> hi THEN 'conflict' WHEN lo = 'F' THEN 'audited' ELSE 'to audit' END AS state FROM g")
def message_audit(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    audited, left, conflicts = observe.audit_split(messages, messages.where("content = 'F'").distinct())
    state = lambda df, s: df.select("instruction", "framing", F.lit(s).alias("state"))
    return state(audited, "audited").unionByName(state(left, "to audit")).unionByName(state(conflicts, "conflict"))


@query("WITH d AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS instruction, l_returnflag AS framing FROM lineitem WHERE l_linestatus = 'O') SELECT instruction, framing, 'O' AS content FROM d")
def delivered_provenance(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    return observe.delivered_provenance(messages.where("content = 'O'"), messages).select("instruction", "framing", "content")


def _judged(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    traces = orders.select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderstatus").alias("trace_fingerprint"), F.when(F.col("o_orderpriority") < "2", "failed").otherwise("completed").alias("terminal_status"))
    judgments = orders.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("trial_id"), F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("trace_fingerprint"))
    return traces, judgments


@query("SELECT o_orderkey AS trial_id, o_orderpriority < '4' AND o_orderstatus <> 'P' AS reused FROM orders")
def judgment_reuse(spark, sf_dir):
    """A judgment is kept only for the trace that it judged."""
    traces, judgments = _judged(spark, sf_dir)
    kept = observe.reusable_judgments(traces, judgments).select("trial_id", F.lit(True).alias("reused"))
    return kept.unionByName(observe.traces_to_judge(traces, judgments).select("trial_id", F.lit(False).alias("reused")))


@query("SELECT o_orderkey AS trial_id, o_orderstatus AS trace_fingerprint, [false, false] AS verdicts FROM orders WHERE o_orderpriority < '2'")
def default_judgments(spark, sf_dir):
    return observe.default_judgments(_judged(spark, sf_dir)[0]).select("trial_id", "trace_fingerprint", "verdicts")


@query("SELECT o_orderkey AS trial_id FROM orders WHERE o_orderpriority < '2'")
def failed_trials(spark, sf_dir):
    return observe.failed_trials(_judged(spark, sf_dir)[0]).select("trial_id")


@query("SELECT o_orderkey AS trial_id FROM orders WHERE (o_orderpriority >= '2') <> (o_orderpriority < '4')")
def status_mismatches(spark, sf_dir):
    traces, judgments = _judged(spark, sf_dir)
    rows = traces.join(judgments.select("trial_id", F.lit("j").alias("judge_response_id")), "trial_id", "left")
    return validate.status_mismatches(rows).select("trial_id")


_CHECK = "c AS (SELECT p_partkey, p_size % 2 = 0 AS f1, p_size % 3 <> 0 AS f2, CAST(p_size % 5 + 1 AS INTEGER) AS d1, CAST(p_size % 4 + 2 AS INTEGER) AS d2, p_retailprice > 1000 AS tools, p_size > 10 AS exclusive FROM part)"
_REASONS = "CASE WHEN NOT f1 THEN 'first instruction is not feasible' END, CASE WHEN d1 NOT BETWEEN 2 AND 4 THEN 'first instruction difficulty ' || d1 END, CASE WHEN NOT f2 THEN 'second instruction is not feasible' END, CASE WHEN d2 NOT BETWEEN 2 AND 4 THEN 'second instruction difficulty ' || d2 END, CASE WHEN NOT tools THEN 'neither instruction requires tools' END, CASE WHEN NOT exclusive THEN 'instructions are not mutually exclusive' END"


@query(f"WITH {_CHECK}, r AS (SELECT p_partkey, list_filter([{_REASONS}], lambda x: x IS NOT NULL) AS reasons FROM c) SELECT p_partkey, reasons, len(reasons) = 0 AS passes FROM r")
def failure_reasons(spark, sf_dir):
    size = F.col("p_size")
    checks = table(spark, sf_dir, "part").select(
        "p_partkey",
        (size % 2 == 0).alias("first_feasible"),
        (size % 3 != 0).alias("second_feasible"),
        (size % 5 + 1).alias("first_difficulty"),
        (size % 4 + 2).alias("second_difficulty"),
        (F.col("p_retailprice") > 1000).alias("requires_tools"),
        (size > 10).alias("mutually_exclusive"),
    )
    return observe.failure_reasons(checks).select("p_partkey", "reasons", "passes")


@query(f"WITH {_BANK} SELECT pair_id FROM bank WHERE pair_id < '3'")
def cached_pair_checks(spark, sf_dir):
    bank = pair_bank(spark, sf_dir)
    saved = bank.where("pair_id < '3'").unionByName(bank.where("pair_id >= '3'").withColumn("first", F.lit("changed")))
    return observe.cached_pair_checks(bank, saved).select("pair_id")


@query(f"WITH {_BANK} SELECT pair_id FROM bank WHERE pair_id < '3' UNION ALL SELECT 'blank' FROM bank WHERE pair_id >= '5' UNION ALL SELECT 'equal' FROM bank WHERE pair_id >= '5'")
def pair_violations(spark, sf_dir):
    """Ids that are no slugs, an instruction with a blank at its end, and two that are equal; the others are made slugs, and fit."""
    bank = pair_bank(spark, sf_dir)
    slug = F.lower(F.regexp_replace("pair_id", "[^A-Za-z0-9]+", "-"))
    last = bank.where("pair_id >= '5'")
    rows = bank.withColumn("pair_id", F.when(F.col("pair_id") < "3", F.col("pair_id")).otherwise(slug))
    rows = rows.unionByName(last.withColumn("pair_id", F.lit("blank")).withColumn("first", F.concat("first", F.lit(" ")))).unionByName(last.withColumn("pair_id", F.lit("equal")).withColumn("second", F.col("first")))
    return validate.pair_violations(rows).select("pair_id")


@query("SELECT o_orderstatus AS instruction, count(*) AS times FROM (SELECT o_orderstatus FROM orders UNION ALL SELECT o_orderpriority FROM orders) GROUP BY ALL HAVING count(*) > 1")
def repeated_instructions(spark, sf_dir):
    bank = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("first"), F.col("o_orderpriority").alias("second"))
    return validate.repeated_instructions(bank)


@query(f"WITH {_SPECS} SELECT pair_id, spec_no, side FROM specs WHERE author = 'user' OR channel = 'README.md'")
def specs_by_author_or_channel(spark, sf_dir):
    specs = design.pair_specs(pair_bank(spark, sf_dir))
    own = specs.where("author = 'user'").unionByName(specs.where("channel = 'README.md' AND author <> 'user'"))
    return own.select("pair_id", "spec_no", "side")


@query(f"WITH {OBS_SQL}, {_STUDIES} SELECT study_id FROM studies WHERE CAST(study_id AS BIGINT) % 13 = 0 OR (c1 <> 'F' AND c2 <> 'F')")
def study_violations(spark, sf_dir):
    """One of the fixture's channels stands for the user's; studies without it, and those whose inputs are made equal, break a rule."""
    user = lambda c: F.col(c).withField("channel", F.when(F.col(f"{c}.channel") == "F", USER_CHANNEL).otherwise(F.col(f"{c}.channel")))
    rows = studies(spark, sf_dir).withColumns({c: user(c) for c in ("input1", "input2")})
    equal = F.col("study_id").cast("long") % 13 == 0
    return validate.study_violations(rows.withColumn("input2", F.when(equal, F.col("input1")).otherwise(F.col("input2")))).select("study_id")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def side_overlap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return validate.side_overlap(lines.where("l_returnflag = 'R'").select("k"), lines.where("l_returnflag = 'A'").select("k"))


@query("SELECT l_partkey, min(l_orderkey) AS first_at FROM lineitem GROUP BY l_partkey")
def ordered_distinct(spark, sf_dir):
    return observe.ordered_distinct(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_orderkey")


@query("SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def union_of_studies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.where("l_returnflag = 'R'").unionByName(lines.where("l_returnflag = 'A'"))


@query("SELECT o_custkey AS k, o_orderdate AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_saved(spark, sf_dir):
    return observe.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("latest"))


@query(f"WITH {_STRATA}, {_SIZES}, q AS (SELECT *, default_pairings * edges // population AS floor, default_pairings * edges % population AS remainder FROM strata JOIN counts USING (pair_id)), p AS (SELECT *, default_pairings - sum(floor) OVER (PARTITION BY pair_id) AS rest, row_number() OVER (PARTITION BY pair_id ORDER BY remainder DESC, channel1, channel2, framing_differs, author_differs) AS place FROM q), z AS (SELECT pair_id, unnest([channel1, channel2]) AS channel, floor + CASE WHEN place <= rest THEN 1 ELSE 0 END AS quota FROM p), e AS (SELECT pair_id, channel, sum(quota) AS ends FROM z GROUP BY ALL), n AS (SELECT pair_id, channel, count(*) AS nodes FROM specs GROUP BY ALL) SELECT pair_id, channel, nodes, round(CAST(ends AS DOUBLE) / nodes, 9) AS target_degree FROM n JOIN e USING (pair_id, channel)")
def channel_degrees(spark, sf_dir):
    specs = design.pair_specs(pair_bank(spark, sf_dir))
    quotas = design.strata_quotas(design.edge_strata(design.eligible_edges(specs)), design.pairing_counts(specs))
    return rounded(design.channel_degrees(quotas, specs))


@query(f"WITH {_EDGES}, r AS (SELECT pair_id, spec_no1, spec_no2, row_number() OVER (PARTITION BY pair_id ORDER BY CAST(channel1 = 'user message' AS INTEGER) DESC, spec_no1, spec_no2) - 1 AS rank FROM edges) SELECT pair_id, CAST(rank AS INTEGER) AS rank FROM r")
def rank_bijection(spark, sf_dir):
    """Ranks whose arithmetic gives back the edge that was numbered: all of them."""
    edges = design.ranked_edges(_edges(spark, sf_dir))
    side = lambda k, user: Window.partitionBy("pair_id").orderBy(*([F.desc((F.col(f"channel{k}") == "user message").cast("int"))] if user else []), f"spec_no{k}")
    firsts = edges.select("pair_id", "channel1", "spec_no1").distinct().withColumn("o1", F.row_number().over(side(1, True)) - 1)
    seconds = edges.select("pair_id", "channel2", "spec_no2").distinct()
    every = seconds.withColumn("o2", F.row_number().over(side(2, False)) - 1)
    users = seconds.where("channel2 = 'user message'").withColumn("u2", F.row_number().over(side(2, False)) - 1).drop("channel2")
    sizes = firsts.groupBy("pair_id").agg(F.count_if(F.col("channel1") == "user message").alias("fu"), F.count(F.lit(1)).alias("fa")).join(seconds.groupBy("pair_id").agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("channel2") == "user message").alias("su")), "pair_id")
    rows = edges.join(firsts.drop("channel1"), ["pair_id", "spec_no1"]).join(every.drop("channel2"), ["pair_id", "spec_no2"]).join(users, ["pair_id", "spec_no2"], "left").join(sizes, "pair_id")
    edge = design.edge_of_rank(F.col("rank"), F.col("fu"), F.col("fa") - F.col("fu"), F.col("s"), F.col("su"))
    second = F.when(F.col("o1") < F.col("fu"), F.col("o2")).otherwise(F.col("u2"))
    return rows.where((edge["first"] == F.col("o1")) & (edge["second"] == second)).select("pair_id", "rank")


@query(f"WITH {_SPECS}, {_SIZES}, customers AS (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY c_nationkey), every AS (SELECT 'design' AS of, population FROM counts UNION ALL SELECT 'nations', population FROM customers) SELECT of, population, count(*) AS pairs FROM every e GROUP BY of, population HAVING (SELECT count(DISTINCT x.population) FROM every x WHERE x.of = e.of) > 1")
def ragged_pairs(spark, sf_dir):
    """The design's populations are even, and give no row; those of nations by their customers are not."""
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    even = design.ragged_pairs(design.pairing_counts(design.pair_specs(pair_bank(spark, sf_dir))))
    return even.select(F.lit("design").alias("of"), "*").unionByName(design.ragged_pairs(nations).select(F.lit("nations").alias("of"), "*"))


@query("WITH s AS (SELECT DISTINCT CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), m AS (SELECT s, (s + lead(s) OVER (ORDER BY s)) / 2 AS m FROM s) SELECT s AS threshold FROM m UNION SELECT m FROM m WHERE m IS NOT NULL UNION SELECT nextafter(min(s), '-infinity'::DOUBLE) FROM s UNION SELECT nextafter(max(s), 'infinity'::DOUBLE) FROM s")
def threshold_candidates(spark, sf_dir):
    return probes.threshold_candidates(_labelled(spark, sf_dir).select(F.col("n_chars").alias("score")))


@query("WITH r AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings), e AS (SELECT vec_id, [exp(v - list_max(x)) FOR v IN x] AS e FROM r) SELECT vec_id, round(e[1] / list_sum(e), 9) AS p1, round(e[4] / list_sum(e), 9) AS p4, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS label FROM e")
def softmax_predictions(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", probes.predict(x).alias("r"))
    return rounded(rows.select("vec_id", F.col("r.p")[0].alias("p1"), F.col("r.p")[3].alias("p4"), F.col("r.label").alias("label")))


@query("SELECT doc_id, CASE WHEN n_chars >= 1500 THEN 'reasoning' ELSE 'final' END AS called FROM documents")
def classified_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", probes.classify(F.col("n_chars"), F.lit(1500)).alias("called"))


@query("SELECT (SELECT count(*) FROM documents) AS requested, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS answered, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unexpected")
def probe_coverage(spark, sf_dir):
    return probes.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("WITH p AS (SELECT lang AS pair, list_sort(list(round(n_chars / (n_chars + 1000.0::DOUBLE), 6))) AS probabilities FROM documents WHERE lang = 'fr' GROUP BY lang) SELECT pair, len(probabilities) AS n, probabilities[1] AS least, probabilities[-1] AS most FROM p")
def descriptive_probabilities(spark, sf_dir):
    expectation = F.when(F.col("lang") == "fr", "descriptive").otherwise("reasoning")
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("pair"), expectation.alias("expectation"), F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6).alias("probability"))
    return probes.descriptive_probabilities(rows).groupBy("pair").agg(F.sum("times").alias("n"), F.min("probability").alias("least"), F.max("probability").alias("most"))


@query("SELECT conv_id AS document, turn AS idx, count(DISTINCT (text, length(text))) AS kinds, count(DISTINCT role) AS roles FROM conversations GROUP BY ALL HAVING count(DISTINCT (text, length(text))) > 1 OR count(DISTINCT role) < 2")
def neutral_pairs(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("idx"), "role", F.col("text").alias("token"), F.length("text").alias("position"))
    return probes.neutral_pair_violations(tokens)


@query("SELECT doc_id, CAST(count_if(quality IS NOT NULL AND toxic = 0) AS BIGINT) AS scores, CAST(count_if(toxic = 1) AS BIGINT) AS errors FROM (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 7 = 0) GROUP BY doc_id HAVING count_if(quality IS NOT NULL AND toxic = 0) + count_if(toxic = 1) <> 1")
def score_xor_error(spark, sf_dir):
    """Every seventh document is judged twice."""
    labels = table(spark, sf_dir, "labels")
    labels = labels.unionByName(labels.where("doc_id % 7 = 0"))
    rows = labels.select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("score"), F.when(F.col("toxic") == 1, F.lit("e")).alias("error"))
    return validate.score_xor_error(rows, ["doc_id"])


@query("SELECT p_partkey FROM part WHERE abs(round(p_size / 50.0::DOUBLE, 6) + round(p_size / 100.0::DOUBLE, 6) - 1) > 1e-6")
def role_probability_violations(spark, sf_dir):
    share = lambda d: F.round(F.col("p_size") / d, 6)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("reasoning"), share(50.0), F.lit("final"), share(100.0)).alias("role_probabilities"))
    return validate.role_probability_violations(rows).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 = 0 END AS complies FROM orders")
def json_fields(spark, sf_dir):
    """Ids only where they are strings, booleans only where they are booleans and stand alone."""
    key = F.col("o_orderkey")
    payload = F.when(key % 2 == 0, F.to_json(F.struct(key.cast("string").alias("id")))).otherwise(F.to_json(F.struct(key.alias("id"))))
    verdict = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct((key % 3 == 0).alias("complies")))).otherwise(F.to_json(F.struct((key % 3).alias("complies"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.response_id(payload).alias("id"), text.strict_boolean(verdict, "complies").alias("complies"))


@query("SELECT p_brand, count(*) AS n, round((count_if(p_size > 25) + 0.5) / (count(*) - count_if(p_size > 25) + 0.5), 9) AS odds FROM part GROUP BY p_brand")
def smoothed_odds(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    return rounded(parts.select("p_brand", "n", stats.smoothed_odds(F.col("k"), F.col("n")).alias("odds")))


@query(f"WITH {OBS_SQL} SELECT assistant, pair_id AS pair, count(*) // 2 AS comparisons, count(DISTINCT ({_CELL})) AS cells FROM obs GROUP BY ALL")
def block_sizes(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.groupBy("assistant", F.col("pair_id").alias("pair")).agg(F.floor(F.count(F.lit(1)) / 2).alias("comparisons"), F.countDistinct("cell_id").alias("cells"))


@query(f"WITH {OBS_SQL}, {_STUDIES} SELECT study_id, assistant, p AS permutation, q AS position, CASE WHEN assistant <> 'P' THEN p / (p + q)::DOUBLE END AS score, CASE WHEN assistant = 'P' THEN 'no score' END AS error FROM studies, (VALUES (1), (2)) x(p), (VALUES (1), (2)) y(q)")
def scored_requests(spark, sf_dir):
    """A scorer that fails for one assistant: its requests become error rows, the others are scored."""
    requests = design.probe_requests(studies(spark, sf_dir)).select("study_id", "assistant", "permutation", "position")

    def scorer(rows):
        if rows["assistant"].iloc[0] == "P":
            raise RuntimeError("no score")
        return rows.assign(score=rows["permutation"] / (rows["permutation"] + rows["position"]))

    return observe.score_requests(requests, scorer, "study_id string, assistant string, permutation int, position int, score double, error string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS leading, 'text ' || o_orderkey AS content, 'tool' AS tool, '{\"n\":' || o_orderkey || '}' AS arguments, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS complies, o_orderkey % 4 <> 0 AS written FROM orders")
def response_fields(spark, sf_dir):
    """Contents, tool calls, verdicts with issues, input order and placeholders."""
    key = F.col("o_orderkey")
    arguments = F.concat(F.lit('{"n":'), key.cast("string"), F.lit("}"))
    call = F.struct(F.lit("c").alias("id"), F.struct(F.lit("tool").alias("name"), arguments.alias("arguments")).alias("function"))
    message = F.struct(F.concat(F.lit("text "), key.cast("string")).alias("content"), F.array(call).alias("tool_calls"))
    payload = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    none, one = F.array().cast("array<string>"), F.array(F.lit("bad"))
    verdict = F.to_json(F.struct((key % 3 != 1).alias("complies"), F.when(key % 3 == 0, none).otherwise(one).alias("issues")))
    inputs = F.array(F.lit("first"), F.lit("second"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("p"), verdict.alias("v"), text.ordered_inputs(inputs, (2 - key % 2).cast("int"))[0].alias("leading"), text.is_written(F.when(key % 4 == 0, " TODO: write").otherwise("x")).alias("written"))
    first = text.tool_calls(F.col("p"))[0]
    return rows.select("o_orderkey", "leading", text.response_content(F.col("p")).alias("content"), first["name"].alias("tool"), first["arguments"].alias("arguments"), text.verdict_with_issues(F.col("v"))["complies"].alias("complies"), "written")
