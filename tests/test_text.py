"""Golden cases of the text, price, url and stock rules."""

import html
import unicodedata
from decimal import Decimal
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwatch.functions.constants import ENGLISH_CATEGORIES
from shelfwatch.functions.prices import money, with_price
from shelfwatch.functions.stock import classify_stock
from shelfwatch.functions.text import (
    category_from_url, english_category, english_text, normalize_ascii_title, normalize_title, title_case, unescape,
)
from shelfwatch.functions.urls import resolve_url, site
from shelfwatch.sources.targets import category_id_from_url, category_ids_from_html


def apply(spark, values, column, schema="v string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.select("i", column.alias("out")).orderBy("i").select("out").collect()]


PRICES = [
    ("$39.99", "39.99", "USD"), ("€29.50", "29.50", "EUR"), ("£15.00", "15.00", "GBP"), ("USD 39.99", "39.99", "USD"),
    ("1,299.00", "1299.00", "USD"), ("1.299,00", "1299.00", "USD"), ("39,99", "39.99", "USD"), ("1,000", "1000.00", "USD"),
    (None, None, "USD"), ("", None, "USD"), ("   ", None, "USD"), ("  Price: $49.95  ", "49.95", "USD"), ("$0.00", "0.00", "USD"),
    ("$1,999.99", "1999.99", "USD"), ("1.299", "1.30", "USD"), ("1.299.000", None, "USD"), ("5-10", None, "USD"), ("-5.00", None, "USD"),
    ("Rs. 500", "0.50", "USD"), ("call us", None, "USD"), ("99 kr", "99.00", "SEK"), ("CAD 12.5", "12.50", "CAD"), ("12 zł", "12.00", "PLN"),
    ("$5 EUR", "5.00", "EUR"), ("٣٫٥", "35.00", "USD"), ("١٢.٥", "12.50", "USD"), ("1,23,456", "123456.00", "USD"), ("5,", "5.00", "USD"),
    ("eur 7", "7.00", "EUR"), ("¥1,200", "1200.00", "JPY"), ("9999999999999", None, "USD"),
]


def test_prices(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i int, raw string")
    out = with_price(rows, F.col("raw")).orderBy("i").collect()
    got = [(r.price, r.currency) for r in out]
    assert got == [(None if p is None else Decimal(p), c) for _, p, c in PRICES]


def test_price_default_currency(spark):
    rows = spark.createDataFrame([("39,99", "EUR"), ("$1", "EUR")], "raw string, d string")
    out = with_price(rows, F.col("raw"), F.col("d")).collect()
    assert [(str(r.price), r.currency) for r in out] == [("39.99", "EUR"), ("1.00", "USD")]


TITLES = ["HELLO WORLD", "  hello  ", "Black Hoodie - Men's (XL)", "black   hoodie", "café naïve", "", None, "a b", "snake_case 2x",
          "Straße №5", "ﬁne ½", "日本語 タイトル", "tab\tnew\nline", "x\x1fy"]


def folded(title):
    """The rule in words: compatibility decomposition, lower case, anything but word characters is a blank."""
    text = unicodedata.normalize("NFKD", title or "").lower()
    return " ".join("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split())


def test_titles(spark):
    assert apply(spark, TITLES, normalize_title(F.col("v"))) == [folded(t) for t in TITLES]


def test_ascii_titles_need_no_python(spark):
    plain = [t for t in TITLES if t is None or t.isascii()]
    rows = spark.createDataFrame([(t,) for t in plain], "v string").select(normalize_ascii_title(F.col("v")).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in rows.collect()] == [folded(t) for t in plain]


def test_title_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", normalize_title(F.col("text")).alias("n"))
    for row in docs.collect():
        assert row.n == folded(row.text)


BASES = ["https://example.com", "https://example.com/shop/", "https://example.com/a/b/c?x=1", "http://www.example.com:8080/a"]
LINKS = ["https://example.com/product/123", "/product/123", "product/123", "../up", "../../../top/", "./here", "?page=2", "#frag", "//cdn.example.com/x.png",
         "mailto:a@b.c", "a//b", "/a/./b/../c", "..", ".", "x?y=/../z", "/p#a/../b", "ftp://other/x"]


def test_links_resolve_like_the_standard_library(spark):
    pairs = [(link, base) for base in BASES for link in LINKS]
    got = apply(spark, pairs, resolve_url(F.col("v"), F.col("b")), "v string, b string")
    for (link, base), url in zip(pairs, got):
        parsed = urlparse(link)
        assert url == (link if parsed.scheme and parsed.netloc else urljoin(base, link)), (link, base)
    assert apply(spark, [("", "https://e.com"), (None, "https://e.com")], resolve_url(F.col("v"), F.col("b")), "v string, b string") == ["", None]


def test_site(spark):
    assert apply(spark, ["https://WWW.Shop.com/x", "http://shop.com:81", "nonsense", "https://www2.shop.com"], site(F.col("v"))) == [
        "shop.com", "shop.com:81", "", "www2.shop.com"]


def test_stock(spark):
    cases = {"In Stock": "in_stock", "Add to Cart": "in_stock", "Available": "in_stock", "Out of Stock": "out_of_stock", "Sold Out": "out_of_stock",
             "Unavailable": "out_of_stock", "not available": "in_stock", "Buy now": "in_stock", "in-stock": "in_stock", "out-of-stock": "out_of_stock",
             "": "unknown", None: "unknown", "Some random text": "unknown"}
    assert apply(spark, list(cases), classify_stock(F.col("v"))) == list(cases.values())


def test_title_case(spark):
    cases = ["mm2pets world", "men's wear", "UPPER case", "a1b2", "élan vital"]
    assert apply(spark, cases, title_case(F.col("v"))) == [c.title() for c in cases]


def test_category_from_url(spark):
    cases = {"https://x.com/collections/steal-a-brainrot?p=1": "Steal A Brainrot", "https://x.com/collections/mm2--pets/": "Mm2 Pets", "https://x.com/": None}
    assert apply(spark, list(cases), category_from_url(F.col("v"))) == list(cases.values())


def test_english_parts(spark):
    cases = {"ماب السرقة كايلو - Steal a Caylu": "Steal a Caylu", "plain": "plain", "A - ١٢": "A", "١ - ٢": "١ - ٢", "": "", "x &amp; y - z &amp; w": "z & w"}
    assert apply(spark, list(cases), english_text(F.col("v"))) == list(cases.values())
    cases = {"ماب السرقة": "Steal a Brainrot", "روبوكس": "Robux", "Pets": "Pets", "": None, None: None}
    assert apply(spark, list(cases), english_category(F.col("v"), ENGLISH_CATEGORIES)) == list(cases.values())


def test_unescape(spark):
    cases = ["a &amp;lt; b", "&lt;&gt;&quot;&#39;&apos;", "&eacute; &amp; x", "&copy 2024", "&#x41;&#66;", "plain", "a & b", None]
    assert apply(spark, cases, unescape(F.col("v"))) == [None if c is None else html.unescape(c) for c in cases]


def test_category_ids(spark):
    cases = {"https://t.com/en/-/c306488438/?lang=en": "306488438", "https://e.com/en/api/v1/products?source_value[]=123": "123",
             "https://e.com/x?source_value%5B%5D=77&category_id=5": "77", "https://e.com/c12/more": None, "https://e.com/?category_id=9": "9",
             "https://e.com/?source_value=abc": None}
    assert apply(spark, list(cases), category_id_from_url(F.col("v"))) == list(cases.values())
    body = "<a href='/x/c34'><SALLA-products-list a=1 source-value='12'></a><a href='/c12'>"
    assert apply(spark, [body], category_ids_from_html(F.col("v"))) == [["12", "34"]]


def test_money(spark):
    signs = {"USD": "$", "EUR": "€"}
    rows = [("1234.5", "USD"), ("-5", "EUR"), ("0.4", "SAR"), (None, "USD")]
    got = apply(spark, rows, money(F.col("v").cast("decimal(12,2)"), F.col("c"), signs), "v string, c string")
    assert got == ["$1,234.50", "€-5.00", "SAR 0.40", "N/A"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_titles_property(spark, titles):
    titles = [t for t in titles if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)] or ["x"]
    assert apply(spark, titles, normalize_title(F.col("v"))) == [folded(t) for t in titles]


@pytest.mark.parametrize("depth", [1, 3])
def test_dot_segments(spark, depth):
    link = "../" * depth + "z"
    assert apply(spark, [(link, "https://e.com/a/b/c/d")], resolve_url(F.col("v"), F.col("b")), "v string, b string") == [
        urljoin("https://e.com/a/b/c/d", link)]
