"""URL filter by empirical-Bayes host reputation, in DataFrame functions alone.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. At each level
the rate of bad pages gets a beta prior whose mean is the posterior mean of the level above without
the child's own labels, and whose strength is estimated from how much the children of that level differ
beyond binomial noise (moments of the beta-binomial), but is never more than what stands behind that
mean. So a host with many labels speaks for itself, one with few follows its domain, and one with none
its suffix. A page is blocked if even the lower posterior bound of its host's bad
rate is above the limit. Explicit rules on host and path win over the method, the longest first.

Counts are aggregated before they are shuffled; a page row meets one row of its host in a join that
Spark may split where a host is hot. Only four numbers (the overall rate and three prior strengths)
come to the driver.

A suffix is the last label or, below a country's two letters, the last two where the first of them is a
usual second level (`second_level`, a parameter). Addresses in digits stand for themselves.

Defined results: a url that is null or has no `://` has an empty host and path, and its pages share
one reputation; null outcomes are no labels; an id labelled more than once is bad if any label says
so; repeated pages are each answered; an empty table gives an empty result; no labels at all give the
prior mean of one half and no block.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class ReputationConfig:
    z: float = 1.645
    limit: float = 0.5
    weakest: float = 2.0
    strongest: float = 1000.0
    second_level: tuple[str, ...] = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[[0-9a-f:.]*\])$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, cfg: ReputationConfig) -> Column:
    """A country and its second level (co.uk), or the last label; of an address in digits the address."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(_country(two, cfg), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, cfg: ReputationConfig) -> Column:
    """The suffix and one more label; an address in digits is its own domain."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(_country(two, cfg), F.substring_index(name, ".", -3)).otherwise(two)


def _country(two: Column, cfg: ReputationConfig) -> Column:
    """Whether two labels are a country's second level."""
    return two.rlike(_second_level(cfg))


def _second_level(cfg: ReputationConfig) -> str:
    return rf"^({'|'.join(cfg.second_level)})\.[a-z]{{2}}$"


def _name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _strength(cfg: ReputationConfig) -> Column:
    """Prior strength of children from n, k and the parent's mean: moments of the beta-binomial."""
    n, k, m = F.col("n"), F.col("k"), (F.col("pk") + F.col("ps") * F.col("pm")) / (F.col("pn") + F.col("ps"))
    noise = F.sum(n * m * (1 - m))
    share = F.try_divide(F.sum(F.pow(k - n * m, 2)) - noise, F.sum(n * (n - 1) * m * (1 - m)))
    between = F.greatest(F.lit(cfg.weakest), F.least(F.lit(cfg.strongest), F.try_divide(1 - share, share)))
    return F.when(share.isNull() | (share <= 0), F.lit(cfg.strongest)).otherwise(between)


def _with_prior(children: DataFrame, cfg: ReputationConfig) -> DataFrame:
    """Adds m and s, prior mean and strength. children: n, k, and of the parent pn, pk, pm, ps."""
    strength = children.agg(_strength(cfg).alias("s")).first()["s"]
    size = F.col("pn") - F.col("n") + F.col("ps")
    mean = (F.col("pk") - F.col("k") + F.col("ps") * F.col("pm")) / size
    return children.withColumn("m", mean).withColumn("s", F.least(F.lit(float(strength)), size)).drop("pn", "pk", "pm", "ps")


def _as_parent(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.col("n").alias("pn"), F.col("k").alias("pk"), F.col("m").alias("pm"), F.col("s").alias("ps"))


def host_reputation(counts: DataFrame, cfg: ReputationConfig) -> DataFrame:
    """host, n, k -> host, bad_rate, bad_low: posterior mean and lower bound."""
    counts = counts.withColumn("domain", domain_of(F.col("host"), cfg)).withColumn("suffix", suffix_of(F.col("host"), cfg))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    top = {"pn": F.lit(total["n"]), "pk": F.lit(total["k"]), "pm": F.lit(0.5), "ps": F.lit(2.0)}
    suffixes = _with_prior(counts.groupBy("suffix").agg(*sums).withColumns(top), cfg)
    domains = counts.groupBy("domain", "suffix").agg(*sums).join(_as_parent(suffixes, "suffix"), "suffix")
    domains = _with_prior(domains, cfg)
    hosts = _with_prior(counts.join(_as_parent(domains, "domain", "suffix"), ["domain", "suffix"]), cfg)
    p, size = (F.col("k") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s")), F.col("n") + F.col("s")
    low = F.greatest(F.lit(0.0), p - cfg.z * F.sqrt(p * (1 - p) / (size + 1)))
    return hosts.select("host", p.alias("bad_rate"), low.alias("bad_low"), "n", "k")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), cfg: ReputationConfig | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page. outcomes: (id, bad) with bad true, false or null."""
    spark, cfg = pages.sparkSession, cfg or ReputationConfig()
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where("bad IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = rows.join(labels, rows["page_id"] == labels["id"], "left")
    counts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    counts, _ = common.materialize(spark, counts, "hosts")
    reputation, _ = common.materialize(spark, host_reputation(counts, cfg), "reputation")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(reputation.select("host", "bad_low"), "host", "left").withColumn("rule", name)
    by_method = F.when(F.col("bad_low") > cfg.limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, by_method).alias("verdict"))


def op9_hosts(spark, sf_dir: str) -> DataFrame:
    """Outcome of a page: bad if the labels of its id say low quality or toxic."""
    labels = common.table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(common.table(spark, sf_dir, "pages"), outcomes, RULES)


def _prior_sql(name: str, source: str, keys: str) -> str:
    """CTEs name_s (strength) and name (keys, n, k, m, s) from source with pn, pk, pm, ps."""
    m = "((pk + ps * pm) / (pn + ps))"
    return f"""{name}_s AS (SELECT CASE WHEN room = 0 OR room IS NULL OR extra / room <= 0 THEN 1000.0
      ELSE greatest(2.0, least(1000.0, (1 - extra / room) / (extra / room))) END AS strength
    FROM (SELECT sum(pow(k - n * {m}, 2)) - sum(n * {m} * (1 - {m})) AS extra, sum(n * (n - 1) * {m} * (1 - {m})) AS room FROM {source})),
{name} AS (SELECT {keys}, n, k, (pk - k + ps * pm) / (pn - n + ps) AS m, least(strength, pn - n + ps) AS s FROM {source}, {name}_s)"""


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
l AS (
  SELECT doc_id, CAST(max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
hw AS (SELECT *, array_to_string(split(name, '.')[-2:], '.') AS two, regexp_matches(name, '{ADDRESS}') AS is_address FROM h),
hc AS (SELECT *, regexp_matches(two, '{_second_level(ReputationConfig())}') AS is_country FROM hw),
hd AS (SELECT host, n, k, CASE WHEN is_address THEN name WHEN is_country THEN two ELSE split(name, '.')[-1] END AS suffix,
  CASE WHEN is_address THEN name WHEN is_country THEN array_to_string(split(name, '.')[-3:], '.') ELSE two END AS domain FROM hc),
t AS (SELECT coalesce(sum(k), 0)::DOUBLE AS pk, coalesce(sum(n), 0)::DOUBLE AS pn, 0.5::DOUBLE AS pm, 2.0::DOUBLE AS ps FROM hd),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, any_value(pn) AS pn, any_value(pk) AS pk, any_value(pm) AS pm, any_value(ps) AS ps FROM hd, t GROUP BY suffix),
{_prior_sql('s1', 's0', 'suffix')},
d0 AS (SELECT domain, suffix, sum(hd.n)::DOUBLE AS n, sum(hd.k)::DOUBLE AS k, any_value(s1.n) AS pn, any_value(s1.k) AS pk, any_value(m) AS pm, any_value(s) AS ps FROM hd JOIN s1 USING (suffix) GROUP BY domain, suffix),
{_prior_sql('d1', 'd0', 'domain, suffix')},
h0 AS (SELECT host, hd.n::DOUBLE AS n, hd.k::DOUBLE AS k, d1.n AS pn, d1.k AS pk, m AS pm, s AS ps FROM hd JOIN d1 USING (domain, suffix)),
{_prior_sql('h1', 'h0', 'host')},
h4 AS (SELECT host, greatest(0.0, p - 1.645 * sqrt(p * (1 - p) / (n + s + 1))) AS bad_low FROM (SELECT *, (k + s * m) / (n + s) AS p FROM h1)),
r(verdict, rule_host, rule_path) AS (VALUES {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
f AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (host, path) LEFT JOIN h4 USING (host)
"""
