"""URL rules and host reputation."""

from factlog.llm import urls


def judge(spark, pages, labels=(), rules=()):
    p = spark.createDataFrame(pages, "page_id long, url string, host int")
    o = spark.createDataFrame(list(labels), "id long, bad int")
    return {r.id: r for r in urls.judged(p, o, rules).collect()}


def test_hosts_and_rules(spark):
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/"))
    pages = [(1, "http://A.Example.ORG/es/x?y#z", 0), (2, None, 0), (3, "no scheme", 0), (4, "x://h.org?q=/es/", 0), (5, "http://notexample.org/es/", 0), (6, "http://com/de/1#?", 0), (7, "a://b://c/d", 0)]
    out = judge(spark, pages, rules=rules)
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (out[2].host, out[2].path, out[2].rule) == ("", "", None) and out[3].host == ""
    assert (out[4].host, out[4].path, out[4].rule, out[4].verdict) == ("h.org", "", None, "allow")
    assert out[5].rule == "org/" and out[6].rule == "com/de/" and (out[7].host, out[7].path) == ("b:", "//c/d")


def test_reputation_shrinks(spark):
    pages = [(i, f"http://bad.spam.net/{i}", 0) for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.net/{i}", 0) for i in range(200)] + [(900, "http://one.other.net/", 0), (901, "http://new.spam.net/", 0)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(200)] + [(900, 1), (900, 1), (5000, 1), (100, None)]
    out = judge(spark, pages, labels)
    assert out[0].verdict == "block" and out[100].verdict == "allow"
    assert out[900].verdict == "allow", "one bad page doesn't block a host"
    assert out[901].bad_rate > out[100].bad_rate, "a host without labels has its domain's rate"


def test_no_rows_and_no_labels(spark):
    assert judge(spark, []) == {}
    assert judge(spark, [(1, "http://a.net/", 0), (1, "http://a.net/", 0)])[1].verdict == "allow"


def test_query_and_its_sql(spark, tmp_path):
    """Suffixes of two labels, hot hosts, rules and labels, against DuckDB."""
    import duckdb

    from factlog.llm.queries import SQL, op5_urls

    hosts = ["a.shop.co.uk", "b.shop.co.uk", "x.other.co.uk", "co.uk", "one.com", "two.one.com", "bad.example.org", "m.org", ""]
    pages = [(k, f"http://{hosts[k % 9 if k % 3 else 0]}/{'de' if k % 5 else 'en'}/{k}") for k in range(600)] + [(601, None), (602, "none"), (603, "x://H.SHOP.CO.UK?q")]
    labels = [(k, int(k % 7 != 0), int(k % 9 == 0)) for k in range(0, 600, 2)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(SQL["op5_urls"]).df()
    got = op5_urls(spark, str(tmp_path)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want) and set(got["verdict"]) == {"allow", "block"}
