"""Registered queries against their SQL on the smallest tables, and the governance operators on seeded faults."""

import glob
import os

import duckdb
import pytest

from octaspark.operators import corpus, evaluate, html
from octaspark.plans import audit as catalogue

DATA = "/root/testdata/sf0.001"


def canon(df):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = df[sorted(df.columns)].itertuples(index=False)
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_manifest_faults(spark):
    rows = [("a", "utf-8", "train", "g", "1"), ("b", "utf-8", "validation", "g", "2"), ("../c", "utf-8", "train", "h", "3"), ("d", "cp1252", "train", "h", "3"), ("e", "", "dev", "k", "4")]
    got = {(r.rule, r.key) for r in corpus.violations(spark.createDataFrame(rows, "path string, encoding string, split string, `group` string, sha256 string")).collect()}
    assert got == {("group_leak", "g"), ("path_escapes", "../c"), ("duplicate_conflict", "3"), ("empty_field", "encoding"), ("unknown_split", "dev")}


def test_overlap_shifted_and_tampered(spark):
    raw = os.urandom(1024)
    held = spark.createDataFrame([(1, raw[64:]), (2, os.urandom(1024)), (3, raw[:300] + os.urandom(700))], "id int, raw binary")
    train = spark.createDataFrame([(9, raw)], "id int, raw binary")
    assert [r.id for r in corpus.overlap(held, train, "id", "raw").collect()] in ([1], [1, 3], [3, 1])


def test_percentiles_of_ten(spark):
    r = evaluate.percentiles(spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double"), "k", "v").first()
    assert (r.median, r.p95) == (5.5, 9.0)


def test_html_precedence():
    page = b'<!-- <meta charset=koi8-r> --><script>"<meta charset=gbk>"</script><meta charset="windows-1251"><p>\xcf'
    assert html.resolve(page)["encoding"] == "windows-1251" and html.resolve(page)["source"] == "meta"
    assert html.resolve(page, "text/html; charset=gbk")["source"] == "transport"
    assert html.resolve(page, override="koi8-r")["source"] == "override"
    assert html.resolve(b"\xef\xbb\xbf" + page)["encoding"] == "utf-8"
    assert html.resolve(b"plain")["source"] == "fallback"
    assert html.resolve(page, "text/html; charset=utf-16")["encoding"] == "utf-8" and html.resolve(b"x", override="UTF-16")["encoding"] == "utf-16le"
    assert html.resolve(b"plain")["warning"] == html.resolve(page)["warning"] == html.CAVEAT and html.resolve(page, override="gbk")["warning"] is None
    for bad in (lambda: html.http_charset("text/html\r\nx"), lambda: html.resolve(page, override="no-such-label")):
        with pytest.raises(ValueError):
            bad()
    assert all(bytes(range(65, 91)).decode(html.codec_of(name)) == "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for name in set(html.WEB.values()) if not name.startswith("utf-16"))
    assert len(html.WEB) > 200 and html.web_label(" Latin5 ") == "windows-1254" and html.web_label("iso_8859-15") == "iso-8859-15"


def test_bad_rows_say_why(spark):
    rows = [(1, b"<meta charset=koi8-r>", None, None), (2, b"x", "text/html\nx", None), (3, b"x", None, "nope"), (4, None, "text/html; charset=gbk", None)]
    got = {r.id: r for r in html.decode_html(spark.createDataFrame(rows, "id int, raw binary, header string, own string"), transport="header", override="own").collect()}
    assert (got[1].encoding, got[1].error) == ("koi8-r", None) and got[2].error and got[3].error and got[4].encoding == "gbk"
