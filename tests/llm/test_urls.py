import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.llm import urls
from eventloom.llm.queries import op6_url_reputation, oracle_sql

URLS = ["http://A.Example.COM/en/x?q=1#f", "https://www.example.com/en/", "https://example.com", "no scheme", None, "", "x://net/es/1", "x://a.b.net/fr/", "x://foonet/es/1", "ftp://h:80/p://q", "://", "a://?x", "b://#y", "s://x.net/es", "s://spam.co.uk/a", "s://ok.co.uk/b"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("bound", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, none, urls.RULES).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = plain(url)
        fitting = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        _, rule, verdict = max(fitting, default=(0, None, "allow"))
        assert tuple(got[k])[1:5] == (host, path, rule, verdict)


def test_bad_hosts_are_blocked_and_single_bad_pages_are_not(spark):
    rows = [(k, f"s://{host}/{k}", bad) for k, (host, bad) in enumerate([("bad.org", 1)] * 30 + [(f"h{k % 40}.org", int(k % 10 == 0 and k % 40 == 0)) for k in range(2000)] + [(f"m{k % 40}.org", int(k % 3 == 0)) for k in range(2000)] + [("new.org", 1)] + [("bad.org", None)] * 3)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad int")
    verdicts = {(r["host"], r["verdict"]) for r in urls.judge(pages, outcomes, []).collect()}
    assert {h for h, v in verdicts if v == "block"} == {"bad.org", "h0.org"} - {h for h, v in verdicts if v == "allow"} and ("bad.org", "block") in verdicts and ("new.org", "allow") in verdicts


HOSTS = {
    "x.com.sg": ("x.com.sg", "com.sg"), "a.u.edu.au": ("u.edu.au", "edu.au"), "a.b.github.io": ("b.github.io", "github.io"), "github.io": ("github.io", "github.io"), "192.168.10.1:80": ("192.168.10.1", "(address)"),
    "[::1]:8080": ("[::1]", "(address)"), "1.2.3": ("2.3", "3"), "www.example.com:443": ("example.com", "com"), "": ("", ""), "localhost": ("localhost", "localhost"), "b.s3.amazonaws.com": ("b.s3.amazonaws.com", "s3.amazonaws.com"),
    "com.au": ("com.au", "com.au"), "a.co": ("a.co", "co"), "a.com.info": ("com.info", "info"),
}


def test_domains_and_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_domain(hosts).collect()} == HOSTS
    table = spark.createDataFrame([("ck",), ("*.ck",), ("!www.ck",), ("b.example.com",), ("Example.COM",)], "suffix string")
    own = {"a.x.ck": ("a.x.ck", "x.ck"), "x.ck": ("x.ck", "x.ck"), "ck": ("ck", "ck"), "www.ck": ("www.ck", "ck"), "m.www.ck": ("www.ck", "ck"), "c.b.example.com": ("c.b.example.com", "b.example.com"), "c.example.com": ("c.example.com", "example.com")}
    assert {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_domain(spark.createDataFrame([(h,) for h in own], "host string"), table).collect()} == own


def test_posterior_is_between_prior_and_share(spark):
    pages = spark.createDataFrame([(k, f"s://h{k % 5}.org/{k}") for k in range(500)], "page_id long, url string")
    outcomes = spark.createDataFrame([(k, int(k % 5 == 0 and k % 3 > 0)) for k in range(0, 500, 2)], "page_id long, bad int")
    for r in urls.judge(pages, outcomes, []).select("host", "n", "bad", "prior", "mean", "bound").distinct().collect():
        assert r["n"] == 50 and min(r["prior"], r["bad"] / 50) <= r["mean"] <= max(r["prior"], r["bad"] / 50) and r["bound"] < r["mean"]


def test_repeated_and_null_rows(spark):
    pages = spark.createDataFrame([(1, "s://a.org/"), (1, "s://a.org/"), (None, "s://a.org/"), (2, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 1), (2, None)], "page_id long, bad int")
    assert urls.judge(pages, outcomes, []).count() == 4
    assert urls.judge(pages.where("false"), outcomes, urls.RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    query = op6_url_reputation(spark, f"/root/testdata/{sf}")
    assert "Python" not in query._jdf.queryExecution().toString() and "InArrow" not in query._jdf.queryExecution().toString()
    assert sorted(map(str, map(tuple, query.collect()))) == sorted(map(str, db.execute(oracle_sql()["op6_url_reputation"]).fetchall()))
