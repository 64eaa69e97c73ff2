"""JSON texts that are taken apart over ranges: every structural case again, and large documents."""

import json

import pytest
from pyspark.sql import functions as F

from pagecensus.catalog.structure_queries import BASE, BREAKS
from pagecensus.operators.quality import structure
from pagecensus.operators.quality.structure import structural_violations
from pagecensus.sources import json_ranges
from pagecensus.sources.captures import split_documents


def violations(spark, texts, contract):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "run_id string, text string")
    return sorted((r.run_id, r.pointer, r.keyword) for r in structural_violations(df, contract).collect())


@pytest.mark.parametrize("contract,size", [("site-inventory", 3), ("sampling-manifest", 40), ("website-evidence", 7), ("problem", 1)])
def test_taken_apart_texts_break_the_same_rules(spark, monkeypatch, contract, size):
    base = json.dumps(BASE[contract], indent=1, ensure_ascii=False).replace("@URL", "https://s.example/é").replace("@ID", "1")
    compact = json.dumps(BASE[contract], separators=(",", ":")).replace("@ID", "1")
    texts = [base, compact] + [compact.replace(old, new).replace("@URL", "https://s.example/a") for old, new, _ in BREAKS[contract]]
    texts += ["", "[]", "{}", "{", "}", '"', "[1,2", "[{},[]]", base + " ", base + "x", base + "{}", compact.replace("[", "[,", 1), compact.replace("]", ",]", 1)]
    texts += [compact.replace("]", "}", 1), compact.replace("}", "]", 1), compact.replace('"', "'", 1), compact.replace('":', '\\":', 2), compact[:-1], compact[1:]]
    texts += ['{"a":"\\\\","b":["\\"],{","\\\\"],"b":[]}', '{"a":[1,[2,3],{"b":[4]}],"candidates":[]}', "[[1,2],[3]]", '{"a":{"b":1,"c":[2,3]},"d":{}}']
    want = violations(spark, texts, contract)
    monkeypatch.setattr(json_ranges, "WHOLE", 0)
    monkeypatch.setattr(json_ranges, "RANGE", size)
    assert violations(spark, texts, contract) == want
    assert len(want) > 20


def test_well_formedness_is_the_parsers(spark, monkeypatch):
    """Any text made of JSON's own characters is JSON in parts exactly if it is as a whole."""
    import random

    draw = random.Random(7)
    valid = [json.dumps(draw.choice([{"a": [1, {"b": "],[\\"}], "é": []}, [[], {}, ["\\\"", ""]], {"k": {"x": [1, 2]}, "l": [{}]}])) for _ in range(20)]
    texts = set(valid)
    while len(texts) < 500:
        text = list(draw.choice(valid))
        for _ in range(draw.randint(1, 2)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(["", "{", "}", "[", "]", ",", '"', "\\", ":", " ", "1"])
        texts.add("".join(text))
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text string").coalesce(2)
    monkeypatch.setattr(json_ranges, "RANGE", 5)
    kept, bad = split_documents(df.withColumn("n", F.lit(1)), "text", "a variant")
    want = {r.text for r in bad.collect()}
    monkeypatch.setattr(json_ranges, "WHOLE", 0)
    kept_apart, bad_apart = split_documents(df.withColumn("n", F.lit(1)), "text", "a variant")
    assert {r.text for r in bad_apart.collect()} == want and 50 < len(want) < 500
    assert kept_apart.count() == kept.count()


def large_inventory(mib):
    url = "https://s.example/" + "p" * 60 + "/"
    item = '{"url_key":"%s","observed_forms":["%s"],"provenance":["S1"],"eligibility":{"state":"ELIGIBLE"}}'
    n = mib * (1 << 20) // (len(item) + 2 * len(url) + 14)
    head, tail = json.dumps(BASE["site-inventory"], separators=(",", ":")).replace("@ID", "1").split('{"url_key"')
    tail = tail[tail.index("}}") + 2 :]
    items = ",".join(item % (u, u) for u in (f"{url}{i:09d}" for i in range(n)))
    return head + items + tail, n


def test_a_large_inventory(spark):
    text, n = large_inventory(40)
    broken = text.replace('"state":"ELIGIBLE"}}', '"state":"ELIGIBLE"}', 1)
    wrong = text.replace('"provenance":["S1"]', '"provenance":["s1"]', 1)
    twice = text.replace(f"{n - 1:09d}", f"{0:09d}")
    found = violations(spark, [text, broken, wrong, twice, text + "]"], "site-inventory")
    assert found == [
        ("1", "", "json"), ("2", "/candidates/0/provenance/0", "pattern"), ("3", "/candidates", "uniqueItems"), ("4", "", "json"),
    ]


def test_large_lines_are_no_quarantine(spark):
    text, _ = large_inventory(20)
    lines = spark.createDataFrame([(1, text), (2, text[:-1]), (3, '{"run_id":"r"}'), (4, None)], "id int, text string")
    documents, bad = split_documents(lines, "text", "run_id string")
    assert sorted((r.id, r.document.run_id) for r in documents.collect()) == [(1, "run-1"), (3, "r")]
    assert sorted(r.id for r in bad.select("id").collect()) == [2, 4]
    assert documents.columns == ["id", "document"] and bad.columns == ["id", "text"]
    assert structure.is_long is json_ranges.is_long
