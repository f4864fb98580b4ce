"""URL rules by hand, the template tree against its SQL, and planted host behaviour."""

import duckdb
import pytest

from larder.llm import urls
from larder.llm.queries import ORACLE

SCHEMA = "html string, url string, path int, page_id long"


def judged(spark, pages):
    frame = spark.createDataFrame([("h", u, 1, i) for i, u in pages], SCHEMA)
    return {r.page_id: r for r in urls.filtered(frame).collect()}


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://Example.ORG/es/x?q", "example.org", "/es/x", "example.org/es/"),
    ("http://a.example.org/en/1", "a.example.org", "/en/1", "example.org/en/1"),
    ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/"),
    ("http://org", "org", "", None), ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ("x://com/fr/#a", "com", "/fr/", "com/fr/"), ("http://xcom/fr/", "xcom", "/fr/", None),
    ("http://a.com/de/1?x=/fr/", "a.com", "/de/1", "com/de/"), ("no host", "", "", None), (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None), ("http://É.com/FR/", "É.com", "/FR/", None)])
def test_rules(spark, url, host, path, rule):
    frame = spark.createDataFrame([(url, 1)], "url string, page_id long")
    row = urls.ruled(urls.parsed(frame)).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def test_templates_separate_what_the_labels_separate(spark):
    pages = [(i, f"http://s.example.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    pages += [(100 + i, f"http://s.example.com/{p}/{i}") for i, p in enumerate(["FR", "it", "x" * 60])]
    pages += [(200 + i, f"http://bad.example.com/de/{i}") for i in range(30)] + [(300, "http://bad.example.com/other/1")]
    rows = judged(spark, pages)
    assert all(rows[i].verdict == ("allow" if i % 2 else "block") for i in range(40))
    assert rows[300].verdict == "block" and rows[300].rule is None


def test_edge_rows_and_sql(spark):
    pages = [(1, None), (2, ""), (None, "http://com/fr/"), (3, "http://a.b.com/" + "x/" * 3000), (3, "http://a.b.com/de/"),
             (4, "http://"), (5, "://"), (6, "http://org//"), (7, "http://h.net/a/b/c/d/e/f"), (8, "http://h.net/a%20/9")]
    frame = spark.createDataFrame([("h", u, 1, i) for i, u in pages], SCHEMA)
    got = sorted((tuple(r) for r in urls.filtered(frame).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    assert got == sorted(con.execute(ORACLE["op9_url_filters"]).fetchall(), key=repr)
    assert urls.filtered(frame.limit(0)).collect() == []
