"""URL filter: allow and block rules, and an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host.  A host's bad rate is a beta-binomial whose
prior mean is the posterior mean of its registered domain, whose prior is its suffix's,
whose prior is the overall rate.  How strongly each level holds its members together (the
prior's number of pseudo-outcomes) comes from the spread of the members' rates by the
method of moments.  A host is blocked when the lower bound of its posterior bad rate passes
a threshold, so hosts with few outcomes stay near their domain and are not blocked by chance.

Counts are combined before the shuffle; only five numbers a level reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import settle

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASSUMED = (1, 10)  # bad ones among outcomes that are assumed before any are seen
STRENGTH_RANGE = (1.0, 1000.0)
Rule = tuple[str, str]  # ("allow" or "block", host and path such as "example.com/en/")


def url_host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, else empty."""
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), URL_PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), URL_PARTS, 2)


def longest_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits ``host`` and ``path``; nulls where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's; of rules of
    one length the first given wins.  The list is short: it becomes one expression.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1]))

    def fits(rule: str) -> Column:
        host, slash, path = rule.partition("/")
        at_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        return at_host & F.col("path").startswith(slash + path)

    def first_of(values: list[str]) -> Column:
        cases = [F.when(fits(rule), F.lit(v)) for v, (_, rule) in zip(values, ordered)]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    return first_of([rule for _, rule in ordered]), first_of([action for action, _ in ordered])


def domain_levels(suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(suffix, registered domain) of ``host``: the last label, or one of ``suffixes``, and one label more."""
    labels = F.split("host", r"\.")
    known = [F.when(F.col("host").endswith(f".{s}"), F.lit(s.count(".") + 1)) for s in sorted(suffixes, key=lambda s: -len(s))]
    width = F.coalesce(*known, F.lit(1))

    def last(n: Column) -> Column:
        n = F.least(n, F.size(labels))
        return F.array_join(F.slice(labels, -n, n), ".")

    return last(width), last(width + 1)


def prior_strength(groups: DataFrame) -> float:
    """Pseudo-outcomes of the prior that members (n outcomes, bad ones k) of a level share."""
    row = groups.where("n > 0").agg(
        F.count("*").alias("groups"),
        F.sum("n").cast("double").alias("n"),
        F.sum("k").cast("double").alias("k"),
        # As doubles: the square of a level's outcomes need not fit a long.
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    low, high = STRENGTH_RANGE
    if row["groups"] < 2:
        return high
    n, rate = row["n"], row["k"] / row["n"]
    within = rate * (1 - rate)
    spread = row["kk"] - rate * row["k"]
    between = (spread - (row["groups"] - 1) * within) / (n - row["nn"] / n)
    if between <= 0 or within <= 0:
        return high
    return min(high, max(low, within / between - 1))


def host_reputation(hosts: DataFrame, suffixes: tuple[str, ...] = (), z: float = 1.645) -> DataFrame:
    """(host, n, k) to host, n, k, mean and lower (bound) of the posterior bad rate.

    Hosts without outcomes (n = 0) have the posterior of their domain as their prior.
    """
    suffix, domain = domain_levels(suffixes)
    hosts = settle(hosts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    counted = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = settle(hosts.groupBy("suffix", "domain").agg(*counted), "domains")
    suffix_table = settle(domains.groupBy("suffix").agg(*counted), "suffixes")
    total = suffix_table.agg(*counted).first()
    bad, all_ = ASSUMED
    overall = ((total["k"] or 0) + bad) / ((total["n"] or 0) + all_)

    def posterior(prior: Column, strength: float) -> Column:
        return (F.col("k") + prior * strength) / (F.col("n") + F.lit(strength))

    suffix_means = suffix_table.select("suffix", posterior(F.lit(overall), prior_strength(suffix_table)).alias("above"))
    domain_means = domains.join(suffix_means, "suffix").select(
        "domain", posterior(F.col("above"), prior_strength(domains)).alias("above")
    )
    strength = prior_strength(hosts)
    a = F.col("above") * strength + F.col("k")
    b = (1 - F.col("above")) * strength + F.col("n") - F.col("k")
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domain_means, "domain").select(
        "host", "n", "k", mean.alias("mean"), F.greatest(mean - z * deviation, F.lit(0.0)).alias("lower")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    suffixes: tuple[str, ...] = (),
    threshold: float = 0.3,
    z: float = 1.645,
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, n, bad_rate, lower.

    ``outcomes`` (page_id, bad) labels some pages; null ones are ignored.  The longest fitting
    rule decides, else the reputation: ``block`` if the lower bound is above ``threshold``.
    A null url, or one without ``://``, has an empty host and path, and the empty host has a
    reputation like any other.  Repeated rows count and are returned each time; other columns
    are ignored; without outcomes every host has the same prior of 0.1.
    """
    parts = pages.select(F.col("page_id"), url_host().alias("host"), url_path().alias("path"))
    labelled = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").select(
        F.col("page_id").alias("of_page"), F.col("bad").cast("int").alias("bad")
    )
    counts = (
        parts.select("page_id", "host")
        .join(labelled, F.col("page_id") == F.col("of_page"), "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    )
    reputation = settle(host_reputation(counts, suffixes, z), "reputation")
    rule, action = longest_rule(rules)
    by_method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return parts.join(reputation, "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(action, by_method).alias("verdict"),
        "n",
        F.col("mean").alias("bad_rate"),
        "lower",
    )


def any_bad(*conditions: Column) -> Column:
    """1 if any condition holds, 0 if all are known not to, else null."""
    return reduce(lambda x, y: x | y, conditions).cast("int")
