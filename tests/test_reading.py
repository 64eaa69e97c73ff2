"""Classification, indexability, texts, HTML, sitemaps, encodings: golden cases as small tables."""

import gzip
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.classify import type_of_words, words
from pagecensus.functions.columns import declared_charset, media_type, representable, single_line, strict_json
from pagecensus.functions.content import joined_urls, undone_content
from pagecensus.functions.html import page_tags, with_page
from pagecensus.functions.indexability import combined_verdict, header_verdict, meta_verdict
from pagecensus.functions.sitemap import with_sitemap


def column_of(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_page_types_of_texts(spark):
    cases = {
        "/impressum": "LEGAL", "/angebot-anfordern": "CONTACT", "/ueber_uns/": "ABOUT", "/leistungen.html": "OFFER",
        "/teamsport": None, "/kontakt/agb": "LEGAL", "/%C3%BCber/blog": "KNOWLEDGE", "/a%20preise": "OFFER",
        "/case-study": "PROOF", "": None, "Unser Team": "ABOUT", "/impressum.php5": "LEGAL",
    }
    assert column_of(spark, cases, lambda c: type_of_words(words(c))) == list(cases.values())


def test_header_lines(spark):
    cases = [
        ([], "ABSENT"), (["noindex"], "PRESENT"), (["NOINDEX , nofollow"], "PRESENT"), (["none"], "PRESENT"),
        (["googlebot: noindex"], "ABSENT"), (["googlebot: follow, noindex"], "ABSENT"),
        (["max-snippet: 20, noindex"], "PRESENT"), (["unavailable_after: noindex"], "ABSENT"),
        (["noindex: yes"], "INDETERMINATE"), ([": noindex"], "INDETERMINATE"), ([" , "], "ABSENT"),
        (["googlebot: follow", "noindex"], "PRESENT"), (["noindex: x", "noindex"], "PRESENT"),
        (["noindex: x", "follow"], "INDETERMINATE"), (["follow, noindex: x"], "ABSENT"),
    ]
    assert column_of(spark, [c for c, _ in cases], header_verdict, "v array<string>") == [v for _, v in cases]


def test_meta_and_combination(spark):
    assert column_of(
        spark, [["a, NoIndex"], ["index"], [], ["noindexer"]], lambda c: meta_verdict(c, F.lit(False)), "v array<string>"
    ) == ["PRESENT", "ABSENT", "ABSENT", "ABSENT"]
    assert column_of(
        spark, [["none"], ["index"]], lambda c: meta_verdict(c, F.lit(True)), "v array<string>"
    ) == ["PRESENT", "INDETERMINATE"]
    names = ["PRESENT", "ABSENT", "INDETERMINATE", "NOT_APPLICABLE", "UNASSESSED"]
    pairs = [[a, b] for a in names for b in names]

    def expected(pair):
        if "PRESENT" in pair:
            return "PRESENT"
        if {"INDETERMINATE", "UNASSESSED"} & set(pair):
            return "INDETERMINATE"
        return "ABSENT" if "ABSENT" in pair else "NOT_APPLICABLE"

    assert column_of(spark, pairs, combined_verdict, "v array<string>") == [expected(p) for p in pairs]


def test_texts_and_headers(spark):
    assert column_of(spark, ["a\r\n b", "  ", " x 　y\x85", "a\x00b"], single_line) == ["a b", "", "x y", "a b"]
    assert column_of(spark, ["x" * 500, "x" * 501, " "], representable) == ["x" * 500, None, None]
    assert column_of(spark, ["Text/HTML ; charset=x", ";", None, "a/b"], media_type) == ["text/html", None, None, "a/b"]
    assert column_of(
        spark, ['text/html; Charset="utf-8"', "a; charset='x'", "a; charset=", "a", "a;b=c;\tcharset = y "], declared_charset
    ) == ["utf-8", "x", None, None, "y"]
    valid = column_of(
        spark, ['{"a":1}', '{"a":1} x', '{} {}', '{}] y', '{}} y', "NaN", '{"a":NaN}', "[1]", '"a":1}'],
        lambda c: strict_json(c).isNotNull(),
    )
    assert valid == [True, False, False, False, False, False, False, True, False]


def test_joined_urls(spark):
    rows = [["b", "/c", "?q", "http://[::1", "//h/x"]]
    out = column_of(spark, rows, lambda c: joined_urls(F.lit("https://s.example/a/d"), c), "v array<string>")
    assert out == [["https://s.example/a/b", "https://s.example/c", "https://s.example/a/d?q", None, "https://h/x"]]


@pytest.fixture
def page(spark):
    def read(html, url="https://s.example/d/", charset=None, links=False):
        body = html if isinstance(html, bytes) else html.encode()
        df = spark.createDataFrame([(body, charset, url)], "body binary, charset string, url string")
        return with_page(df, F.col("body"), F.col("charset"), F.col("url"), links).first().page.asDict()

    return read


@pytest.fixture
def read_sitemap(spark):
    def read(body, truncated):
        df = spark.createDataFrame([(body, truncated)], "body binary, truncated boolean")
        return with_sitemap(df, F.col("body"), F.col("truncated")).first().sitemap.asDict()

    return read


def test_html_facts(page):
    found = page(
        "<title>A &amp; B</title><title>C</title><META NAME=' Description ' content='d1'><meta name=description content=d2>"
        "<link rel='alternate CANONICAL' href=' ../x '><link rel=canonical href=y>"
        "<meta name=robots content=noindex><meta name=googlebot content=none><meta name=ROBOTS content='a'>"
    )
    assert (found["title"], found["meta_description"]) == ("A & B", "d1")
    assert found["canonical_href"] == " ../x " and found["canonical_url"] == "https://s.example/x"
    assert found["robots"] == ["noindex", "a"]
    assert page("<p>x")["title"] is None and page("<title></title>")["title"] == ""
    assert page("<title>open")["title"] == "open" and page("<title>a &amp; b")["title"] == "a & b"
    assert page("<link rel=canonical href='http://[::1'>")["canonical_url"] is None
    assert page("<title>ä</title>".encode("latin-1"), charset="latin-1")["title"] == "ä"
    assert page(b"<title>\xff</title>", charset="no-such")["title"] == "�"
    assert page(b"<title>x</title>", charset="base64")["readable"] is False


def test_html_links(page):
    found = page(
        "<base href='/b/'><base href='/ignored/'><a href=x> One\n two </a><a href='y'>a<a href=z title=T> </a>"
        "<area href=/m alt=M><a name=n>no</a><a href='http://[::1'>bad</a><a href=' '>blank</a>"
        f"<a href=l>{'w' * 121}</a><a href=o aria-label=L></a><a href=end>E", links=True
    )["links"]
    root = "https://s.example/b/"
    assert [(link["href"], link["label"]) for link in found] == [
        (root + "x", "One two"), (root + "y", "a"), (root + "z", "T"), ("https://s.example/m", "M"),
        (root + "l", None), (root + "o", "L"), (root + "end", "E"),
    ]
    assert [link["pos"] for link in found] == list(range(7))


@pytest.mark.parametrize("piece", ["<a", "<a b=", "<!--", "<title", "&"])
def test_unterminated_markup_is_linear(piece):
    start = time.time()
    page_tags((piece * (131072 // len(piece))).encode(), None, True)
    assert time.time() - start < 3


def test_sitemaps(read_sitemap):
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    good = f"{ns}<url><loc> https://s.example/a </loc></url><loc>no</loc><url><x><loc>no</loc></x></url></urlset>".encode()
    assert read_sitemap(good, False) == {"root": "urlset", "verdict": "USED", "locs": ["https://s.example/a"]}
    assert read_sitemap(gzip.compress(good), False)["locs"] == ["https://s.example/a"]
    assert read_sitemap(good.decode().encode("utf-16"), False)["verdict"] == "USED"
    assert read_sitemap(b"<urlset/>", False)["verdict"] == "EMPTY"
    assert read_sitemap(good[:-5], False)["verdict"] == "MALFORMED"
    assert read_sitemap(good[:-5], True) == {"root": "urlset", "verdict": "BUDGET_EXHAUSTED", "locs": ["https://s.example/a"]}
    assert read_sitemap(b"<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>", False)["verdict"] == "MALFORMED"
    assert read_sitemap(b"<a>" * 9 + b"</a>" * 9, False)["verdict"] == "MALFORMED"
    assert read_sitemap(b"<html/>", False)["verdict"] == "MALFORMED"
    assert read_sitemap(b"\x1f\x8bjunk", False)["verdict"] == "MALFORMED"
    index = b"<sitemapindex><sitemap><loc>https://s.example/1</loc></sitemap><url><loc>no</loc></url></sitemapindex>"
    assert read_sitemap(index, False) == {"root": "sitemapindex", "verdict": "USED", "locs": ["https://s.example/1"]}


def test_content_encodings(spark):
    body = b"x" * 100
    raw = zlib.compressobj(wbits=-15)
    long = bytes(5 << 20)
    cases = [
        (gzip.compress(body), "gzip", body), (gzip.compress(body), "x-gzip", body), (zlib.compress(body), "deflate", body),
        (raw.compress(body) + raw.flush(), "deflate", body), (body, "br", None), (body, "gzip", None), (b"", "gzip", None),
        (gzip.compress(long), "gzip", long), (gzip.compress(body)[:-4], "gzip", body), (None, "gzip", None),
    ]
    df = spark.createDataFrame([(i, w, e) for i, (w, e, _) in enumerate(cases)], "i int, w binary, e string")
    found = df.select("i", undone_content(F.col("w"), F.col("e")).alias("out")).orderBy("i").collect()
    assert [r.out and bytes(r.out) for r in found] == [want for _, _, want in cases]


def test_address_ranges_are_networks():
    import ipaddress

    for block in V.NON_PUBLIC_IPV4 + V.NON_PUBLIC_IPV6 + V.PUBLIC_IPV4_EXCEPTIONS + V.PUBLIC_IPV6_EXCEPTIONS:
        ipaddress.ip_network(block)


def test_public_addresses(spark):
    import ipaddress

    from pagecensus.operators.targets import with_public_flag

    texts = [
        "8.8.8.8", "10.1.2.3", "100.64.0.1", "192.0.0.9", "192.0.0.8", "224.0.0.1", "255.255.255.255", "1.2.3", "01.2.3.4",
        "::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "2001:4860:4860::8888", "2001:db8::1", "fe80::1%eth0", "fc00::1",
        "ff02::1", "64:ff9b::808:808", "2001:1::1", "2002::1", "1::2::3", "x", "",
    ]
    df = with_public_flag(spark.createDataFrame([(t,) for t in texts], "a string"), "a")
    found = {r.a: r.is_public for r in df.collect()}

    def expected(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return False
        address = getattr(address, "ipv4_mapped", None) or address
        return address.is_global and not address.is_multicast and not address.is_reserved

    assert found == {t: expected(t) for t in texts}
