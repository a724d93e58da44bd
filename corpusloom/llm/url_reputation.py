"""URL filter by rules and by an empirical-Bayes reputation of hosts, in built-in functions only.

Pages with known outcomes are counted by host, registered domain and public suffix. The share of bad pages of a host is
shrunk twice: the posterior mean of all pages is the prior mean of every suffix, that of a suffix the prior mean of its
domains, that of a domain the prior mean of its hosts. How strongly a level is shrunk is estimated from the data by
moments: the more the shares of the children of one parent differ beyond binomial noise, the weaker the prior. A host is
blocked if the lower bound of its posterior (a beta distribution, taken as normal) is above ``MOST_BAD``: it takes
evidence to block, and a host without labelled pages is judged by its domain and suffix.

The outcome of a page is the row of ``labels`` of its id: bad if the quality is 0 or the text is toxic.

A rule fits the urls of its host and of all subdomains whose path begins with the rule's; of several the longest decides,
of equally long ones the one that blocks. A page without a fitting rule has the verdict of its host.

Defined results: a null url and one without ``://`` have an empty host and path, and the empty host has a reputation like
any other; a port or user name belongs to the host that rules are held against, but not to the name that reputations are
kept by; several labels of one id count once, bad if any of them says so; labels without an id, or with neither quality nor
toxicity, say nothing; repeated pages are each counted and judged; without labels every host is allowed. An address in
numbers is its own domain, with an empty suffix. Columns other than the key, the url, the label's id and its two marks are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.storage import cut, join_measured, table

#: (verdict, host and path) of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Share of bad pages that the lower bound must pass, and the deviations that the bound lies below the mean (95 % one-sided).
MOST_BAD, DEVIATIONS = 0.5, 1.645
#: Pages that a prior weighs where too few children tell, and the least and most that the estimate can give.
PRIOR_PAGES, LEAST_PRIOR, MOST_PRIOR = 20.0, 2.0, 10_000.0
#: Names below a country that are part of the public suffix (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_levels(hosts: DataFrame) -> DataFrame:
    """Add name (the host without user, port and last dot), domain and suffix to rows with a host."""
    name = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")
    country = " AND ".join(["size(labels) > 2", "length(labels[size(labels) - 1]) = 2", f"labels[size(labels) - 2] IN {SECOND_LEVEL}"])
    kept = F.expr(f"if(name rlike '^[0-9.]+$' OR name like '[%', 0, if({country}, 2, 1))")
    found = hosts.withColumn("name", name).withColumn("labels", F.split("name", r"\.")).withColumn("kept", kept)
    suffix = F.expr("if(kept = 0, '', array_join(slice(labels, -least(kept, size(labels)), kept), '.'))")
    domain = F.expr("if(kept = 0, name, array_join(slice(labels, -least(kept + 1, size(labels)), kept + 1), '.'))")
    return found.withColumns({"suffix": suffix, "domain": domain}).drop("labels", "kept")


def labelled_hosts(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """(host, labelled, bad) of every host; labels: (label_key, quality, toxic)."""
    outcome = F.coalesce(F.greatest(F.expr("quality = 0"), F.expr("toxic = 1")).cast("int"), F.lit(None))
    known = labels.select(F.col(label_key).alias("key"), outcome.alias("bad")).where("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
    rows = pages.select(F.col(key).alias("key"), host_of(url).alias("host"))
    told = rows.join(known, "key").select("host", F.lit(1).alias("labelled"), "bad")
    silent = rows.select("host", F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    return told.unionByName(silent).groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _merged(children: DataFrame, *names: str) -> DataFrame:
    """Parents with their sums, and what the spread of their children tells about the prior."""
    told = "labelled > 0"
    return children.groupBy(*names).agg(
        F.sum("labelled").alias("labelled"),
        F.sum("bad").alias("bad"),
        F.count_if(F.expr(told)).alias("children"),
        F.sum(F.expr(f"if({told}, bad * bad / labelled, 0D)")).alias("spread"),
        F.sum(F.expr("1D * labelled * labelled")).alias("squares"),
    )


def prior_pages(parents: DataFrame) -> float:
    """Pages that the prior of the children weighs, by moments of the spread pooled over all parents."""
    within = "spread - 1D * bad * bad / labelled"
    noise = "(bad / labelled) * (1 - bad / labelled)"
    excess = F.sum(F.expr(f"({within}) / ({noise}) - (children - 1)")).alias("excess")
    scale = F.sum(F.expr("labelled - squares / labelled - (children - 1)")).alias("scale")
    found = parents.where("children > 1 AND bad > 0 AND bad < labelled").agg(excess, scale).first()
    if not found["scale"] or found["scale"] <= 0:
        return PRIOR_PAGES
    likeness = found["excess"] / found["scale"]  # of two pages of one child, beyond those of one parent
    return MOST_PRIOR if likeness <= 0 else min(MOST_PRIOR, max(LEAST_PRIOR, 1 / likeness - 1))


def _shrunk(mean: str, weight: float) -> Column:
    return F.expr(f"(bad + {mean} * {weight!r}D) / (labelled + {weight!r}D)")


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, name, domain, suffix, labelled, bad, mean, bound) of rows (host, labelled, bad)."""
    named = cut(name_levels(hosts), "host-outcomes")
    names = cut(named.groupBy("name", "domain", "suffix").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "name-outcomes")
    domains = cut(_merged(names, "suffix", "domain"), "domain-outcomes")
    suffixes = cut(_merged(domains, "suffix"), "suffix-outcomes")
    top = _merged(suffixes)
    all_pages = top.first()
    # one bad page of two imagined ones keeps the mean off its ends
    overall = ((all_pages["bad"] or 0) + 1) / ((all_pages["labelled"] or 0) + 2)
    of_suffix, of_domain, of_name = prior_pages(top), prior_pages(suffixes), prior_pages(domains)
    suffix_means = suffixes.select("suffix", _shrunk(f"{overall!r}D", of_suffix).alias("suffix_mean"))
    domain_means = join_measured(domains, suffix_means, ["suffix"]).select("suffix", "domain", _shrunk("suffix_mean", of_domain).alias("domain_mean"))
    judged = join_measured(names, domain_means, ["suffix", "domain"]).withColumn("mean", _shrunk("domain_mean", of_name))
    deviation = F.expr(f"sqrt(mean * (1 - mean) / (labelled + {of_name!r}D + 1))")
    judged = cut(judged.select("name", "mean", (F.col("mean") - DEVIATIONS * deviation).alias("bound")), "name-reputations")
    return join_measured(named, judged, ["name"]).select("host", "name", "domain", "suffix", "labelled", "bad", "mean", "bound")


def rules_of_hosts(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules) of the hosts that a rule fits; rules are structs of length, verdict, path and the rule itself."""
    if not rules:
        return hosts.select("host", F.expr("array(struct(0 AS length, '' AS verdict, '' AS path, '' AS rule))").alias("rules")).limit(0)
    said = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        values = (host.translate(str.maketrans(_UPPER, _LOWER)), len(rule), verdict, slash + path, rule)
        said.append(F.struct(*(F.lit(v).alias(n) for v, n in zip(values, ("of", "length", "verdict", "path", "rule")))))
    listed = hosts.sparkSession.range(1).select(F.inline(F.array(*said)))
    ends = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 100000), '.'))")
    found = hosts.select("host", F.explode(ends).alias("of")).join(F.broadcast(listed), "of")
    return found.groupBy("host").agg(F.collect_set(F.struct("length", "verdict", "path", "rule")).alias("rules"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every page. rules: (verdict, host and path), few enough for the driver."""
    known = cut(reputations(labelled_hosts(pages, labels, key, url, label_key)), "reputations")
    blocked = known.where(F.col("bound") > MOST_BAD).select("host", F.lit(True).alias("blocked"))
    hosts = rules_of_hosts(known.select("host"), rules).join(blocked, "host", "full")
    rows = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    best = F.expr("array_max(transform(filter(rules, r -> startswith(path, r.path)), r -> struct(r.length, r.verdict, r.rule)))")
    judged = join_measured(rows, cut(hosts, "judged-hosts"), ["host"], "left").withColumn("best", best)
    verdict = F.coalesce("best.verdict", F.expr("if(blocked, 'block', 'allow')"))
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), p AS (
  SELECT u.*, string_split(name, '.') AS l FROM (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM u) AS u
), levels AS (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]+$') OR name LIKE '[%' THEN 0
    WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM p
), hosts AS (
  SELECT name, CASE WHEN k = 0 THEN '' ELSE array_to_string(l[-least(k, len(l)):], '.') END AS suffix,
    CASE WHEN k = 0 THEN name ELSE array_to_string(l[-least(k + 1, len(l)):], '.') END AS domain, count(bad) AS n, coalesce(sum(bad), 0) AS b
  FROM levels LEFT JOIN known ON doc_id = page_id GROUP BY ALL
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(b) AS b, count(*) FILTER (n > 0) AS c, sum(CASE WHEN n > 0 THEN b * b / n ELSE 0 END) AS s, sum(n * n) AS q FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(b) AS b, count(*) FILTER (n > 0) AS c, sum(CASE WHEN n > 0 THEN b * b / n ELSE 0 END) AS s, sum(n * n) AS q FROM domains GROUP BY ALL
), everything AS (
  SELECT sum(n) AS n, sum(b) AS b, count(*) FILTER (n > 0) AS c, sum(CASE WHEN n > 0 THEN b * b / n ELSE 0 END) AS s, sum(n * n) AS q FROM suffixes
), parents AS (
  SELECT 'name' AS level, n, b, c, s, q FROM domains UNION ALL SELECT 'domain', n, b, c, s, q FROM suffixes UNION ALL SELECT 'suffix', n, b, c, s, q FROM everything
), moments AS (
  SELECT level, sum((s - b * b / n) / ((b / n) * (1 - b / n)) - (c - 1)) AS excess, sum(n - q / n - (c - 1)) AS scale
  FROM parents WHERE c > 1 AND b > 0 AND b < n GROUP BY level
), weights AS (
  SELECT w.level, CASE WHEN scale IS NULL OR scale <= 0 THEN 20 WHEN excess <= 0 THEN 10000 ELSE least(10000, greatest(2, scale / excess - 1)) END AS w
  FROM (VALUES ('name'), ('domain'), ('suffix')) AS w(level) LEFT JOIN moments USING (level)
), suffix_means AS (
  SELECT suffix, (x.b + (e.b + 1) / (e.n + 2) * w) / (x.n + w) AS m FROM suffixes AS x, everything AS e, weights WHERE level = 'suffix'
), domain_means AS (
  SELECT domain, suffix, (x.b + m * w) / (x.n + w) AS m FROM domains AS x JOIN suffix_means USING (suffix), weights WHERE level = 'domain'
), means AS (
  SELECT name, (x.b + m * w) / (x.n + w) AS m, x.n + w AS t FROM hosts AS x JOIN domain_means USING (domain, suffix), weights WHERE level = 'name'
), judged AS (
  SELECT page_id, host, path, m - 1.645 * sqrt(m * (1 - m) / (t + 1)) > 0.5 AS blocked FROM p JOIN means USING (name)
), rules AS (
  SELECT verdict, rule, string_split(rule, '/')[1] AS h, rule[strpos(rule, '/'):] AS start
  FROM (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')) AS r(verdict, rule)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
  coalesce(arg_max(verdict, length(rule)), CASE WHEN any_value(blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id, host, path
"""
