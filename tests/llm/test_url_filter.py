import duckdb
from tributary.llm import url_filter as U

from ..conftest import DATA


def test_rules_and_parts(spark):
    urls = {
        "http://a.EXAMPLE.com/en/7?q": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://example.com/en/6": ("example.com", "/en/6", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "https://x.example.net/de/85#top": ("x.example.net", "/de/85", "example.net/de/8", "block"),
        "https://x.example.net/de/75": ("x.example.net", "/de/75", "net/de/", "allow"),
        "http://com/en": ("com", "/en", None, "allow"),
        "http://ÀB.org?/es/": ("Àb.org", "", None, "allow"),
        "ftp://h.org/es/x\ny": ("h.org", "/es/x\ny", "org/es/", "block"),
        "http://a.b/x://c.org/es/": ("a.b", "/x://c.org/es/", None, "allow"),
        "http://www.cheap-pills.example.org/fr/1": ("www.cheap-pills.example.org", "/fr/1", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "old") for i, u in enumerate(urls)] + [(None, "http://example.com/en/6", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    for limit in (U.MAX_INDEX_BYTES, 0):
        got = U.filter_urls(pages, max_index_bytes=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_rarest_token_files_each_rule_once():
    filed = U.compile_rules()
    assert len(filed) == len(U.HOST_RULES) + len(U.PATTERN_RULES)
    assert dict((r.text, t) for t, r in filed if r.text)["net/de/"] in ("net", "de")


def test_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view pages as from '{DATA}/pages.parquet'")
    want = sorted(map(str, db.execute(U.ORACLE_SQL["op1_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in U.op1_url_filter(spark, sf_dir).collect()) == want
