from corpus_fixtures import rows
from pyspark.sql import functions as F
from tidemark.llm import bloom, url_filter

URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en", "http://EXAMPLE.net/es/5?x#y",
    "http://net/es/", "http://anet/es/", "https://b.org/p/?utm_source=f&b=2&a=1#z", "https://www.b.org/p.html?a=1&b=2", None, "",
    "no url", "://", "http://", "ftp://h", "http://h?q=/x/", "http://h#/x", "http://a://b/c", "http://Ünï.com/é", "x" * 50_000 + "://long.com/",
    "http://b.org/p?ref=1", "http://b.org/p", "http://b.org/p",
]


def judged(spark, listed):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    keys = spark.createDataFrame([(u,) for u in listed], "listed string")
    return {r.page_id: r for r in url_filter.judge(pages, keys).collect()}


def test_rules(spark):
    got = judged(spark, [])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(6)] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("x.www.example.com", "/en", "com/", "allow"), ("example.net", "/es/5", "net/es/", "block"),
        ("net", "/es/", "net/es/", "block"), ("anet", "/es/", None, "allow"),
    ]
    for i in (8, 9, 10, 11, 12):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    assert [(got[i].host, got[i].path) for i in (13, 14, 15, 16)] == [("h", ""), ("h", ""), ("h", ""), ("a:", "//b/c")]
    assert got[17].host == "Ünï.com".replace("N", "n") and got[18].host == "long.com"


def test_list(spark):
    got = judged(spark, ["b.org/p?a=1&b=2", "example.net/es/5?x", "a.example.com/en/1"])
    assert {i for i in got if got[i].listed} == {0, 3, 6, 7}
    assert got[6].verdict == got[7].verdict == "block" and got[19].verdict == got[20].verdict == "allow"


def test_a_rule_beats_the_list(spark):
    got = judged(spark, ["example.com/en/1"])
    assert got[1].listed and got[1].verdict == "allow"


def test_false_hits_are_removed(spark):
    """One block for many keys makes nearly every probe a possible hit."""
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    marked = bloom.mark(spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key")), "key", bloom.build(keys, "key", 1), 1, "hit")
    assert marked.where("NOT hit").join(keys, "key").count() == 0 and marked.where("hit").count() > 3900
    roomy = bloom.blocks_for(2000)
    marked = bloom.mark(spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key")), "key", bloom.build(keys, "key", roomy), roomy, "hit")
    assert 2000 <= marked.where("hit").count() < 2400


def test_the_filter_is_bounded():
    assert bloom.blocks_for(0) == 1 and bloom.blocks_for(10**12) == bloom.MAX_BLOCKS


def test_native_and_exact_join(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    plan = url_filter.judge(pages, spark.createDataFrame([("a.b/c",)], "listed string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ShuffledHashJoin" in plan and "Cartesian" not in plan


def test_listed_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html"), (2, "http://a.b/en/8"), (3, None), (4, "http://a.b/7/x"), (5, "http://m.a.b/en/7?ref=2")], "page_id bigint, url string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    assert rows(url_filter.listed_urls(pages, labels)) == [("a.b/en/7",)]


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([], "listed string")).count() == 0
