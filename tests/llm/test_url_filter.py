import re
from collections import Counter

import duckdb

from dendrospark.llm import url_filter
from dendrospark.llm.entry import OP10_SQL, op10_url_bloom

URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/en/1x?y", "http://example.org/es/", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a#b", "http://com/de/", "http://x.net/a://b", "HTTP://www.spam-farm.example.net/a.html", "http://spam-farm.example.net/a", "http://spam-farm.example.net/a/", "http://m.spam-farm.example.com/de/1", "http://ok.example.net/x", "http://ok.example.net/x", "x?u=http://a.org/b", "http://user@h.org:80/p", "http://É.org/É"]


def judged(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].translate({65 + i: 97 + i for i in range(26)})
        path = re.split("[?#]", rest[len(host) :])[0]
    fits = [(len(h), len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if canonical(host, path) in listed and host else "allow"


def canonical(host, path):
    return re.sub(r"^www\.", "", host) + re.sub(r"(/|\.html)$", "", path)


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, canonical string").repartition(3)


def test_query_against_plain_python_and_sql(spark, folder):
    listed = set()
    for u in URLS:
        host, path, _, _ = judged(u, set())
        if {"spam-farm", "cheap-pills"} & set(host.split(".")):
            listed.add(canonical(host, path))
    where = folder(pages=pages(spark))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op10_url_bloom(spark, where).collect())
    assert got == Counter((i, *judged(u, listed)) for i, u in enumerate(URLS))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{where}/pages.parquet/*.parquet')")
    assert Counter(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP10_SQL})").fetchall()) == got


def test_false_positives_are_removed(spark):
    """With a single block nearly every URL passes the filter; the verdicts stay exact."""
    urls = [f"http://h{i}.example.net/p" for i in range(300)]
    listed = spark.createDataFrame([(f"h{i}.example.net/p",) for i in range(0, 300, 3)] + [(None,), ("",)], "url string")
    out = url_filter.judge(pages(spark, urls), listed, blocks=1).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(0, 300, 3))


def test_no_false_negatives_and_bounded_filter(spark):
    listed = spark.range(5000).selectExpr("concat('u', id) AS url")
    bits = url_filter.bloom_filter(listed, "url", 64)
    assert bits.count() <= 64
    joined = listed.withColumn("block", url_filter.block_of(listed["url"], 64)).join(bits, "block")
    assert joined.where(url_filter.passes(joined["url"])).count() == 5000


def test_plan_has_no_python(spark, folder):
    df = op10_url_bloom(spark, folder(pages=pages(spark)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark, folder):
    assert op10_url_bloom(spark, folder(pages=pages(spark).limit(0))).count() == 0
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://spam-farm.example.net/a"]), none).collect()} == {"allow"}


def test_filter_grows_with_the_list():
    assert url_filter.blocks_for(0) == url_filter.LEAST_BLOCKS and url_filter.blocks_for(10**12) == url_filter.MOST_BLOCKS
    for n in (10**5, 10**6, 10**7):
        blocks = url_filter.blocks_for(n)
        assert blocks & (blocks - 1) == 0 and 256 * blocks >= 16 * n and url_filter.pass_rate(n, blocks) < 0.003


def test_pass_rate_is_about_right(spark):
    listed = spark.range(40_000).selectExpr("concat('h.example/', id) AS url")
    blocks = url_filter.blocks_for(40_000)
    bloom = url_filter.bloom_filter(listed, "url", blocks)
    probe = spark.range(20_000).selectExpr("concat('other.example/', id) AS u")
    joined = probe.withColumn("block", url_filter.block_of(probe.u, blocks)).join(bloom, "block", "left")
    rate = joined.where(url_filter.passes(joined.u)).count() / 20_000
    assert rate < 3 * url_filter.pass_rate(40_000, blocks) + 0.001
