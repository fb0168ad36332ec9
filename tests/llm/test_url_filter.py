import pytest

from pitchframe.llm import queries, url_filter
from pitchframe.llm.queries import URL_RULES
from pitchframe.llm.url_filter import host_reputation, judge_urls


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame(list(outcomes), "page_id long, bad int")
    rows = judge_urls(pages, labels, URL_RULES).collect()
    return {r["page_id"]: r for r in rows}


def test_rules_and_parts(spark):
    urls = [
        "http://WWW.Example.com/en/1?q=/x#y",
        "https://a.example.com/en/2",
        "x://shop.com",
        "x://shop.com/",
        "http://b.net/es/1",
        "http://b.net?/es/1",
        "http://notnet/es/1",
        None,
        "no host",
        "http://",
    ]
    got = judged(spark, urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/"),
        ("a.example.com", "/en/2", "example.com/en/"),
        ("shop.com", "", None),
        ("shop.com", "/", "com/"),
        ("b.net", "/es/1", "net/es/"),
        ("b.net", "", None),
        ("notnet", "/es/1", None),
        ("", "", None),
        ("", "", None),
        ("", "", None),
    ]
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow", "block", "allow", "allow", "block"] + ["allow"] * 5


def test_bad_hosts_are_blocked_by_weight_of_evidence(spark):
    urls = ["http://bad.x.org/1"] * 60 + ["http://good.x.org/1"] * 200 + ["http://rare.x.org/1"] + ["http://fine.y.org/1"] * 200
    outcomes = [(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 260)] + [(260, 1)] + [(i, 0) for i in range(261, 461)]
    got = judged(spark, urls, outcomes)
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow"
    assert 0 < got[260]["bad_rate"] < 1


def test_posterior_shrinks_towards_the_domain(spark):
    hosts = spark.createDataFrame([("a.d.org", 0, 0), ("b.d.org", 50, 25), ("c.d.org", 50, 25), ("e.f.org", 50, 0)], "host string, n long, k long")
    rows = {r["host"]: r["mean"] for r in host_reputation(hosts).collect()}
    assert rows["a.d.org"] == pytest.approx(rows["b.d.org"], abs=0.1) and rows["e.f.org"] < 0.2


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    assert judge_urls(pages, labels, URL_RULES).count() == 0
    assert judged(spark, ["http://a.org/"])[0]["verdict"] == "allow"


def test_many_outcomes_do_not_overflow(spark):
    groups = spark.createDataFrame([(4_000_000_000, 1_000_000_000), (5_000_000_000, 4_900_000_000)], "n long, k long")
    low, high = url_filter.STRENGTH_RANGE
    assert low <= url_filter.prior_strength(groups) <= high


def test_suffixes_keep_sites_apart(spark):
    hosts = spark.createDataFrame([("a.one.co.uk", 40, 40), ("b.two.co.uk", 40, 0), ("c.two.co.uk", 0, 0)], "host string, n long, k long")
    found = {r["host"]: r["mean"] for r in url_filter.host_reputation(hosts, queries.SUFFIXES).collect()}
    assert found["c.two.co.uk"] < 0.3 < found["a.one.co.uk"]
