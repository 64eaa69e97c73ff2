"""What the findings of the fourth round were about, one small case each."""

import pytest
from pyspark.sql import functions as F

from pagecensus.functions import sitemap, url
from pagecensus.session import spread
from pagecensus.sources import discovery

PLACE = "urlset/url/loc"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_locations_of_one_place_are_one_list():
    """every location came as an object with a path of its own, three times as dear as the text."""
    xml = "<urlset>" + "".join(f"<url><loc>https://x/{i}</loc></url>" for i in range(80)) + "</urlset>"
    found = sitemap.location_texts(xml.encode())
    assert found["places"] == [{"path": PLACE, "texts": [f"https://x/{i}" for i in range(80)]}]


@pytest.mark.parametrize("xml, texts", [
    (b'<urlset xmlns="a" xmlns:n="b"><url><loc>1</loc><n:loc>2</n:loc></url><n:url><loc>3</loc></n:url></urlset>', ["1", "2", "3"]),
    (b"<urlset><url><loc>a<b>x</b>c</loc><loc>d<loc>e</loc>f</loc></url><loc>no</loc></urlset>", ["ac", "ef"]),
    (b"<urlset><a><url><loc>no</loc></url></a><url><loc>1</loc><loc>2", ["1"]),
    (b"<loc>no</loc>", []),
])
def test_locations_of_odd_documents(xml, texts):
    """names count without their namespace, in document order, as far as a document goes."""
    found = sitemap.location_texts(xml)
    assert [t for p in found["places"] if p["path"] == PLACE for t in p["texts"]] == texts


def test_depth_costs_no_paths():
    """each element wrote out the path of all it stands in, which took minutes for a deep document."""
    target = sitemap._LocationTexts()
    for name in ["urlset", "url", *["a", "loc"] * 50_000]:
        target.start(name, {})
    assert target.root == "urlset"
    assert len(target.places) == 3


def test_most_forms_are_their_own_keys(spark, monkeypatch):
    """22 us were spent on a form nothing is wrong with; the short way gives what the stages give."""
    host, path = "a" * 253, "p" * 1790
    own = ["https://a.example/", "http://a.example/x/-._~!$&'()*+,;=:@//y.html", f"http://{host}/", f"https://a.example/{path}"]
    other = [
        "https://a.example", "https://A.example/x", "HTTPS://a.example/x", "https://a.example:443/x", "https://a.example/x/../y", "https://a.example/.x",
        "https://a.example/%7e", "https://a.example/x?utm_source=y", "https://a.example/x#y", "https://a.example/é", "https://a.example/a b",
        "https://u@a.example/", "https:///x", "ftp://a.example/", f"https://a{host}/", f"https://a.example/p{path}", f"https://{host}/{path}",
        "https://a.example/\\", "https://a.example/x\n", "https://[::1]/", None,
    ]
    rows = spark.createDataFrame([(form,) for form in own + other], "form string")
    assert {r.form for r in rows.where(url._is_own_key(F.col("form"))).collect()} == set(own)
    short = sorted(map(str, url.with_url_identity(rows, "form").collect()))
    url._identity.cache_clear()
    with monkeypatch.context() as m:
        m.setattr(url, "_is_own_key", lambda form: F.lit(False))
        assert sorted(map(str, url.with_url_identity(rows, "form").collect())) == short
    url._identity.cache_clear()


def test_entries_meet_no_other_table(spark):
    """entries were sorted to find their first place, written out and shuffled again for their site."""
    urls = "".join(f"<url><loc>https://s.example/{x}</loc></url>" for x in ["a", "b", "a", "B?q=1", "é", "x" * 1800])
    files = [("https://s.example/sitemap.xml", f"<urlset>{urls}<url><loc>https://other.example/c</loc></url><url><loc>no url</loc></url></urlset>")]
    bodies = spark.createDataFrame(
        [("r", "https://s.example/", name, None, 200, text.encode(), False, False) for name, text in files],
        "run_id string, site string, requested_url string, failure_kind string, status_code int, body binary, truncated boolean, undecodable boolean",
    )
    runs = spark.createDataFrame([("r", "https://s.example/")], "run_id string, site string")
    declared = spark.createDataFrame([], "run_id string, site string, pos int, declared_url string")
    found = discovery.sitemap_tree(runs, declared, bodies)[0]
    plan = plan_of(found)
    assert "SortAggregate" not in plan
    assert 0 <= plan.find("HashAggregate") < plan.find("Join")  # nothing is joined to what has been listed
    want = ["https://other.example/c", "https://s.example/B?q=1", "https://s.example/a", "https://s.example/b", "https://s.example/é"]
    assert sorted((r.run_id, r.site, r.observed_form) for r in found.collect()) == [("r", "https://s.example/", x) for x in want]


def test_rows_that_grow_get_several_tasks(spark):
    """fourteen splits on twelve cores took two rounds, the second nearly idle."""
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).repartition(cores + 1), 4).rdd.getNumPartitions() == 4 * cores
    assert spread(spark.range(10).repartition(cores + 1)).rdd.getNumPartitions() == cores + 1
