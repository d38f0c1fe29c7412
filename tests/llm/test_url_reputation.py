from pointloom.llm import url_reputation as U


def test_hosts_and_rules(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/71?x"), (4, "https://a.b.example.net/de/8/x"), (5, "x://example.org?q=/es/"), (6, "http://org/es/1#t"), (7, "http://notexample.com/en/7"), (8, "http://h.net/de/8"), (8, "http://h.net/de/8"), (9, "http://://en/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([("example.com", 1)] * 5 + [("bad.example.org", 0)] * 50, "host string, good int")
    got = sorted(tuple(r)[:5] for r in U.judge_urls(pages, outcomes).collect())
    rows = {r[0]: r[1:] for r in got}
    assert len(got) == len(urls)
    assert rows[1][:3] == ("", "", None) and rows[2][:3] == ("", "", None)
    assert rows[3] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert rows[4] == ("a.b.example.net", "/de/8/x", "example.net/de/8", "block")
    assert rows[5][:3] == ("example.org", "", None)
    assert rows[6] == ("org", "/es/1", "org/es/", "block")
    assert rows[7] == ("notexample.com", "/en/7", "com/en/", "block")
    assert rows[8] == ("h.net", "/de/8", "net/de/", "allow")
    assert rows[9][0] == ":"


def test_shrinkage(spark):
    outcomes = spark.createDataFrame([("a.x.com", 1)] * 90 + [("a.x.com", 0)] * 10 + [("b.x.com", 0)] * 30 + [("c.y.co.uk", 1), ("d.x.com", None)], "host string, good int")
    got = {r.host: r for r in U.reputations(outcomes).collect()}
    assert got["c.y.co.uk"].suffix == "co.uk" and got["c.y.co.uk"].domain == "y.co.uk"
    assert got["d.x.com"].n == 0 and got["b.x.com"].posterior_mean < got["d.x.com"].posterior_mean < got["a.x.com"].posterior_mean
    assert all(r.bound < r.posterior_mean for r in got.values())
    pages = spark.createDataFrame([(1, "http://b.x.com/"), (2, "http://a.x.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, outcomes).collect()} == {1: "block", 2: "allow"}
    assert U.judge_urls(pages.limit(0), outcomes).count() == 0
    assert U.judge_urls(pages, outcomes.limit(0)).count() == 2
