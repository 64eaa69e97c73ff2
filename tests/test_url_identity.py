"""Identity of written URL forms: keys, refusals, origins, page resources and the invariants."""

import random

import pytest
from pyspark.sql import functions as F

from pagecensus.functions.columns import is_persistable
from pagecensus.functions.url import is_page_resource, with_url_identity

KEYS = [
    ("HTTPS://Shop.Example", "https://shop.example/"),
    ("https://shop.example:443/a", "https://shop.example/a"),
    ("http://shop.example:0080/a", "http://shop.example/a"),
    ("http://shop.example:8080/a", "http://shop.example:8080/a"),
    ("https://shop.example:/a", "https://shop.example/a"),
    ("https://shop.example/a#part two\\", "https://shop.example/a"),
    ("https://shop.example/a/./b/../c/", "https://shop.example/a/c/"),
    ("https://shop.example/a/%2E%2e/b", "https://shop.example/b"),
    ("https://shop.example/../../x", "https://shop.example/x"),
    ("https://shop.example/x/..", "https://shop.example/"),
    ("https://shop.example//a//", "https://shop.example//a//"),
    ("https://shop.example/%c3%a4%7e", "https://shop.example/%C3%A4~"),
    ("https://shop.example/ä|\U0001f600", "https://shop.example/%C3%A4%7C%F0%9F%98%80"),
    ("https://shop.example/a%2fb%5c", "https://shop.example/a%2Fb%5C"),
    ("https://shop.example/?utm_source=x&a=1&&UTM_x=2&gclid=3", "https://shop.example/?a=1"),
    ("https://shop.example/?%75tm_source=x", "https://shop.example/"),
    ("https://shop.example/?utm_source=x;a=1", "https://shop.example/?utm_source=x;a=1"),
    ("https://shop.example/?b=2&a=1", "https://shop.example/?b=2&a=1"),
    ("https://shop.example?x=/?y", "https://shop.example/?x=/?y"),
    ("http://[2001:0DB8:0:0:1:0:0:1]:81/", "http://[2001:db8::1:0:0:1]:81/"),
    ("http://[::]/", "http://[::]/"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:1.2.3.4]/"),
    ("http://[1::2:3]/", "http://[1::2:3]/"),
    ("https://bücher.example/", "https://bücher.example/"),
]
REFUSALS = [
    ("https://user:pw@shop.example/", "CREDENTIALS_PRESENT"),
    ("https://user@shop.example/", "CREDENTIALS_PRESENT"),
    ("https://@shop.example/", "CREDENTIALS_PRESENT"),
    ("https://shop.example\\@other.example/", "FORBIDDEN_CHARACTER"),
    ("https://shop.example/a\\b", "FORBIDDEN_CHARACTER"),
    ("https://shop.example/a b", "FORBIDDEN_CHARACTER"),
    ("https://shop.example/a b", "FORBIDDEN_CHARACTER"),
    ("https://shop.example/a\tb", "FORBIDDEN_CHARACTER"),
    ("https://shop.example　/", "FORBIDDEN_CHARACTER"),
    ("https://shop.example:8²/", "UNUSABLE_AUTHORITY"),
    ("https://shop.example:80:80/", "UNUSABLE_AUTHORITY"),
    ("https://shop%2eexample/", "UNUSABLE_AUTHORITY"),
    ("https://shop.example:0/", "UNUSABLE_AUTHORITY"),
    ("https://shop.example:65536/", "UNUSABLE_AUTHORITY"),
    ("https://:80/", "UNUSABLE_AUTHORITY"),
    ("https:///a", "UNUSABLE_AUTHORITY"),
    ("https:/a", "UNUSABLE_AUTHORITY"),
    ("http://[::1]x/", "UNUSABLE_AUTHORITY"),
    ("ftp://shop.example/", "NOT_ABSOLUTE_HTTP"),
    ("/a", "NOT_ABSOLUTE_HTTP"),
    ("", "NOT_ABSOLUTE_HTTP"),
    ("https://shop.example/%zz", "MALFORMED"),
    ("https://shop.example/?a=100%", "MALFORMED"),
    ("http://[::1/", "MALFORMED"),
    ("http://[1.2.3.4]/", "MALFORMED"),
    ("http://[:::]/", "MALFORMED"),
    ("https://shop／example/", "MALFORMED"),
    ("https://shop.example/" + "a" * 2048, "TOO_LONG"),
    ("https://shop.example/" + "ä" * 600, "TOO_LONG"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(form,) for form, _ in KEYS + REFUSALS]
    found = with_url_identity(spark.createDataFrame(rows, "form string"), "form").collect()
    return {r.form: (r.url_key, r.url_refusal, r.origin) for r in found}


@pytest.mark.parametrize(("form", "key"), KEYS)
def test_key(verdicts, form, key):
    assert verdicts[form][:2] == (key, None)


@pytest.mark.parametrize(("form", "reason"), REFUSALS)
def test_refusal(verdicts, form, reason):
    assert verdicts[form] == (None, reason, None)


def test_origin(spark):
    forms = [
        ("https://www.shop.example/a?b", "https://www.shop.example/"),
        ("http://shop.example:81/a", "http://shop.example:81/"),
        ("https://" + "a" * 254 + ".example/", None),
    ]
    df = with_url_identity(spark.createDataFrame([(f,) for f, _ in forms], "form string"), "form")
    assert {r.form: r.origin for r in df.collect()} == dict(forms)


def test_null_form_has_neither(spark):
    row = with_url_identity(spark.createDataFrame([(None,)], "form string"), "form").first()
    assert (row.url_key, row.url_refusal, row.origin) == (None, None, None)


def test_page_resource(spark):
    cases = {
        "https://s.example/": True, "https://s.example/a.pdf": False, "https://s.example/a.PDF": False,
        "https://s.example/.pdf": True, "https://s.example/a.html": True, "https://s.example/a.xyz": True,
        "https://s.example/a.tar.gz": False, "https://s.example/a.pdf/": True,
        "https://s.example/a?x=.pdf": True, "https://s.example/a.": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.p for r in df.select("u", is_page_resource(F.col("u")).alias("p")).collect()} == cases


def test_random_corpus(spark):
    rng = random.Random(7)
    clean = ["a", "B", "/", ".", "..", "?", "&", "=", "-", "utm_x=1", "%41", "%c3", "ä", "~", ";", ":", "//"]
    hostile = [" ", "\\", "@", "%", "[", "]", "#", " ", "\x7f", "%zz", "：", "::"]

    def form():
        pieces = [rng.choice(hostile if rng.random() < 0.08 else clean) for _ in range(rng.randint(0, 12))]
        scheme = rng.choice(["http://", "HTTPS://", "https://", "//", "ftp://"])
        host = rng.choice(["s.example", "S.example:80", "[::1]", "s.example:8443", "bü.example", "u@s.example"])
        return scheme + host + "/" + "".join(pieces)

    df = spark.createDataFrame([(i, form()) for i in range(3000)], "i int, form string")
    once = with_url_identity(df, "form")
    twice = with_url_identity(once, "url_key", "again_")
    rows = twice.withColumn("persistable", is_persistable(F.col("url_key"))).collect()
    assert len(rows) == 3000
    for r in rows:
        assert (r.url_key is None) != (r.url_refusal is None), r.form
        if r.url_key is not None:
            assert r.again_url_key == r.url_key, r.form
            assert r.persistable, r.form
            assert r.origin is not None and r.url_key.startswith(r.origin), r.form
    assert sum(r.url_key is not None for r in rows) > 500
