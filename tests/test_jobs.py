"""Jobs on small tables: budgets, positions, order independence, findings, lifecycles, streams, bundles."""

import hashlib
import itertools
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from pagecensus import schemas
from pagecensus.functions import fixed_values as V
from pagecensus.operators import census, digests, inventory, lifecycle, targets
from pagecensus.operators.findings import findings
from pagecensus.operators.quality import problems, repeats
from pagecensus.operators.quality.structure import structural_violations
from pagecensus.operators.ranking import with_position
from pagecensus.plans.acquisition import acquire, observed_captures, wanted_captures
from pagecensus.plans.discovery import discover
from pagecensus.operators.measurements import measurements
from pagecensus.session import ensure_checkpoint_dir
from pagecensus.sources import archive, bundle, discovery
from pagecensus.sources.captures import read_captures, read_documents
from pagecensus.streaming.captures import capture_stream, for_each_batch, measurement_stream

SITE = "https://s.example/"


def observations(spark, rows):
    return spark.createDataFrame([("r1", SITE, *row) for row in rows], schemas.OBSERVATION)


OBSERVED = [
    (SITE, "CANONICAL_SEED", None), ("https://s.example", "LINKS", "Start"), ("https://s.example/a#x", "LINKS", "Kontakt"),
    ("https://S.example/a", "SITEMAP", None), ("https://s.example/a", "LINKS", "Impressum"), ("https://s.example/b.pdf", "LINKS", None),
    ("https://other.example/", "LINKS", None), ("https://u:p@s.example/", "LINKS", None), ("HTTPS://s.example/c", "LINKS", None),
    ("https://s.example/d?x=team", "LINKS", ""), ("https://s.example/a#x", "LINKS", "Kontakt"),
]


def test_inventory_and_census(spark):
    admitted = inventory.admitted_observations(observations(spark, OBSERVED))
    found = {r.url_key: r for r in inventory.candidates(admitted).collect()}
    assert {k: (r.exclusion_reason, r.page_type) for k, r in found.items()} == {
        SITE: (None, "HOMEPAGE"), SITE + "a": (None, "LEGAL" if "Impressum" < "Kontakt" else "CONTACT"),
        SITE + "b.pdf": ("NON_PAGE_RESOURCE", None), "https://other.example/": ("OFF_ORIGIN", None),
        SITE + "d?x=team": (None, "ABOUT"),
    }
    forms = {(r.url_key, r.observed_form) for r in inventory.candidate_forms(admitted).collect()}
    assert (SITE + "a", "https://S.example/a") in forms and (SITE, "https://s.example") in forms
    candidates = inventory.candidates(admitted)
    ranked = [(r.url_key, r.selection_rank, r.selection_reason) for r in census.selections(candidates, 2).orderBy("selection_rank").collect()]
    assert ranked == [(SITE, 1, "SEED"), (SITE + "a", 2, "CENSUS")]
    everything = census.selections(candidates).orderBy("selection_rank").collect()
    assert [r.url_key for r in everything] == [SITE, SITE + "a", SITE + "d?x=team"]
    row = census.plan_summary(candidates, 2).first()
    assert (row.candidate_count, row.selected_count, row.left_by_budget, row.incompleteness_cause) == (5, 2, 1, "SELECTION_BUDGET_EXHAUSTED")


@pytest.mark.parametrize("budget", [0, -1, True, 1.5, "3"])
def test_budget_must_be_a_whole_number(spark, budget):
    with pytest.raises(ValueError):
        census.checked_budget(budget)


def test_a_run_without_an_eligible_seed_plans_nothing(spark):
    candidates = inventory.candidates(inventory.admitted_observations(observations(spark, OBSERVED[2:])))
    assert census.selections(candidates, 5).count() == 0 and census.plan_summary(candidates, 5).count() == 0


def test_positions_match_a_window_under_skew(spark):
    rows = [("hot" if i % 3 else f"g{i % 50}", (i * 7919) % 10007) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int")
    placed = with_position(df, ["g"], [F.col("v")], "n", ranges=7).collect()
    by_group = {}
    for r in placed:
        by_group.setdefault(r.g, []).append((r.n, r.v))
    for found in by_group.values():
        ordered = sorted(found)
        assert [n for n, _ in ordered] == list(range(1, len(found) + 1))
        assert [v for _, v in ordered] == sorted(v for _, v in found)
    assert len(placed) == 6000


def whole(spark, rows):
    runs = spark.createDataFrame([("r1", SITE)], "run_id string, site string").withColumn("generated_at", F.timestamp_seconds(F.lit(0)))
    attempts = spark.createDataFrame(
        [("r1", SITE, s, "USED") for s in ("CANONICAL_SEED", "LINKS", "SITEMAP")], schemas.SOURCE_ATTEMPT
    )
    return discover(runs, observations(spark, rows), attempts, 2)


def test_digests_do_not_depend_on_order_and_match_json(spark):
    first, second = whole(spark, OBSERVED), whole(spark, list(reversed(OBSERVED)))
    one, two = first.inventories.first(), second.inventories.first()
    assert (one.input_digest, one.output_digest) == (two.input_digest, two.output_digest)
    assert first.manifests.first().output_digest == second.manifests.first().output_digest
    forms, names = {}, {}
    for r in first.forms.collect():
        forms.setdefault(r.url_key, []).append(r.observed_form)
    for r in first.sources.collect():
        names.setdefault(r.url_key, []).append(r.source_id)
    listed = []
    for c in sorted(first.candidates.collect(), key=lambda r: r.url_key):
        eligibility = {"state": c.eligibility_state}
        if c.exclusion_reason:
            eligibility["exclusion_reason"] = c.exclusion_reason
        item = {"url_key": c.url_key, "observed_forms": sorted(forms[c.url_key]), "provenance": sorted(names[c.url_key]), "eligibility": eligibility}
        listed.append(item | ({"page_type": c.page_type} if c.page_type else {}))
    document = {
        "candidates": listed, "classifier": V.CLASSIFIER, "classifier_version": V.CLASSIFIER_VERSION,
        "discovery_method": V.DISCOVERY_METHOD, "discovery_method_version": V.DISCOVERY_METHOD_VERSION,
        "sources": sorted(
            ({"source_id": a.source_id, "outcome": a.outcome, "candidate_count": a.candidate_count} for a in first.attempts.collect()),
            key=lambda s: s["source_id"],
        ),
        "target_origin": SITE,
    }
    text = json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert one.output_digest == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    runs = first.inventories.select("run_id", F.col("target_origin").alias("site"))
    parts = digests.document_texts(digests.inventory_fragments(runs, first.candidates, first.forms, first.sources, first.attempts))
    assert "".join(r.text for r in parts.orderBy("part_no").collect()) == text


def test_assembled_documents_satisfy_their_structure(spark):
    found = whole(spark, OBSERVED)
    headers = found.inventories.withColumn("site", F.col("target_origin"))
    texts = {
        "site-inventory": digests.inventory_fragments(
            headers, found.candidates, found.forms, found.sources, found.attempts, whole=True
        ),
        "sampling-manifest": digests.whole_manifest_fragments(found.manifests, found.selections, found.exclusions),
    }
    for contract, fragments in texts.items():
        parts = F.array_sort(F.collect_list(F.struct("part_no", "text")))
        text = digests.document_texts(fragments).groupBy(F.col("doc_id").alias("run_id")).agg(
            F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
        )
        assert json.loads(text.first().text)["schema_version"] == "1.0.0"
        assert structural_violations(text, contract).collect() == []


def capture(url, **given):
    base = {
        "run_id": "r1", "site": SITE, "requested_url": url, "failure_kind": None, "final_url": url, "status_code": 200,
        "content_type": "text/html", "x_robots_tag": [], "is_https": True, "redirect_count": 0,
        "body": bytearray(b"<title>T</title>"), "truncated": False, "undecodable": False, "declared_charset": None,
    }
    return base | given


def captures(spark, rows):
    names = [f.name for f in spark.createDataFrame([], schemas.CAPTURE).schema.fields if f.name != "captured_at"]
    schema = schemas.CAPTURE.replace(", captured_at timestamp", "")
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return df.withColumn("captured_at", F.timestamp_seconds(F.lit(5)))


def test_measurement_branches(spark):
    rows = [
        capture(SITE + "ok", body=bytearray(b"<title> </title><link rel=canonical href=/x><meta name=description content=d>")),
        capture(SITE + "cut", body=bytearray(b"<p>"), truncated=True),
        capture(SITE + "gone", status_code=404), capture(SITE + "pdf", content_type="application/pdf", x_robots_tag=["noindex"]),
        capture(SITE + "bad", undecodable=True), capture(SITE + "lost", final_url="ftp://x/"),
        capture(SITE + "dns", failure_kind="DNS_FAILURE", final_url=None, status_code=None, body=None),
        capture("x" * 10, failure_kind="TIMEOUT", final_url=None, status_code=None, body=None),
        capture(SITE + "long", body=bytearray(b"<title>" + b"t" * 501 + b"</title>")),
    ]
    observed = observed_captures(captures(spark, rows))
    status = {r.requested_url: (r.document_status, r.acquisition_outcome, r.withheld_reason) for r in observed.collect()}
    assert status[SITE + "gone"] == ("NON_SUCCESS_STATUS", "RESPONSE_RECEIVED", None)
    assert status[SITE + "lost"] == ("NO_RESPONSE", "INVALID_REDIRECT", None)
    assert status["x" * 10] == ("WITHHELD", "TIMEOUT", V.WITHHELD_REASON)
    facts = {}
    for r in measurements(observed).collect():
        a, v = r.assessment, r.result
        stated = None if v is None else next((x for x in (v.boolean_value, v.integer_value, v.text_value, v.url_value) if x is not None), None)
        facts[(r.url_key, r.metric_id)] = (a.result_state or a.not_assessed_reason, stated)
        assert (a.not_assessed_reason is None) == (a.result_state is not None and a.collection_mode is not None)
        assert (v is not None) == (a.result_state == "KNOWN")
    assert facts[(SITE + "ok", "PAGE_TITLE_PRESENT")] == ("KNOWN", False)
    assert facts[(SITE + "ok", "PAGE_TITLE")] == ("NOT_APPLICABLE", None)
    assert facts[(SITE + "ok", "CANONICAL_URL")] == ("KNOWN", SITE + "x")
    assert facts[(SITE + "ok", "META_DESCRIPTION")] == ("KNOWN", "d")
    assert facts[(SITE + "cut", "PAGE_TITLE_PRESENT")] == ("UNKNOWN", None)
    assert facts[(SITE + "cut", V.META_NOINDEX)] == ("UNKNOWN", None)
    assert facts[(SITE + "gone", "PAGE_TITLE")] == ("UNSUPPORTED", None) and facts[(SITE + "gone", "HTTP_STATUS")] == ("KNOWN", 404)
    assert facts[(SITE + "pdf", "PAGE_TITLE")] == ("NOT_APPLICABLE", None) and facts[(SITE + "pdf", V.HEADER_NOINDEX)] == ("KNOWN", True)
    assert facts[(SITE + "bad", "PAGE_TITLE")] == ("RUNTIME_ERROR", None) and facts[(SITE + "bad", V.META_NOINDEX)] == ("RUNTIME_ERROR", None)
    assert facts[(SITE + "dns", "HTTP_STATUS")] == ("PROVIDER_FAILURE", None)
    assert facts[(SITE + "long", "PAGE_TITLE_PRESENT")] == ("KNOWN", True) and facts[(SITE + "long", "PAGE_TITLE")] == ("UNKNOWN", None)
    assert len(facts) == 8 * 13


def test_each_selection_has_one_record(spark):
    found = whole(spark, OBSERVED)
    twice = captures(spark, [capture(SITE), capture(SITE, status_code=500)])
    got = acquire(found.selections, twice, found.manifests)
    records = {r.url_key: r for r in got.records.collect()}
    assert set(records) == {SITE, SITE + "a"} and got.records.count() == 2
    assert records[SITE + "a"].acquisition_outcome == "RUNTIME_ERROR" and records[SITE + "a"].http_status is None
    ids = {r.measurement_id for r in got.measurements.collect()}
    assert ids == {i for r in records.values() for i in r.measurement_refs} and len(ids) == 26
    assert records[SITE].measurement_refs == [
        r.measurement_id for r in got.measurements.where(F.col("url_key") == SITE).orderBy("measurement_no").collect()
    ]


def test_finding_boundaries(spark):
    def measured(i, metric, value_type, state="KNOWN", **value):
        slots = {k: value.get(k) for k in ("boolean_value", "integer_value", "text_value", "url_value")}
        result = None if state != "KNOWN" else (value_type, *slots.values())
        return ("r", "u", 1, f"m{i}", metric, "u", "t", "c", "1", ("OBSERVED", state, None), result)

    rows = [
        measured(0, "HTTP_STATUS", "INTEGER", integer_value=399), measured(1, "HTTP_STATUS", "INTEGER", integer_value=400),
        measured(2, "HTTP_STATUS", "TEXT", integer_value=500), measured(3, "TRANSPORT_IS_HTTPS", "BOOLEAN", boolean_value=False),
        measured(4, "PAGE_TITLE_PRESENT", "BOOLEAN", state="UNKNOWN"), measured(5, "HOMEPAGE_GENERIC_NOINDEX_PRESENT", "BOOLEAN", boolean_value=True),
        measured(6, "PAGE_TITLE", "BOOLEAN", boolean_value=False), measured(7, "PAGE_TITLE_PRESENT", "BOOLEAN", boolean_value=True),
    ]
    ms = spark.createDataFrame(rows, schemas.MEASUREMENT)

    def cited(i, refs, state="KNOWN", run="r"):
        return (run, f"e{i}", "u", "t", "s", "c", "1", ("OBSERVED", state, None), None, refs)

    evidence = [cited(i, [f"m{i}"]) for i in range(8)] + [
        cited(8, ["m1"], state="UNKNOWN"), cited(9, ["m1"], run="other"), cited(10, ["gone"]), cited(11, ["m0", "m1"]), cited(12, ["m6", "m1"]),
    ]
    found = findings(spark.createDataFrame(evidence, schemas.EVIDENCE), ms).collect()
    assert {(r.rule_id, r.evidence_refs[0]) for r in found} == {
        ("HTTP_ERROR_RESPONSE", "e1"), ("NON_HTTPS_FINAL_TRANSPORT", "e3"), ("HOMEPAGE_EXPLICIT_NOINDEX", "e5"), ("HTTP_ERROR_RESPONSE", "e12"),
    }


def test_all_state_pairs(spark):
    pairs = list(itertools.product(V.RUN_STATES, repeat=2))
    rows = [(f"{a}>{b}", no, s) for a, b in pairs for no, s in enumerate((a, b))]
    found = lifecycle.audit(spark.createDataFrame(rows, "run_id string, seq int, state string"), ["seq"]).collect()
    illegal = {r.run_id for r in found if r.rule == "illegal_transition" and r.place == 2}
    assert {f"{a}>{b}" for a, b in pairs} - illegal == {f"{a}>{b}" for a, b in V.LEGAL_TRANSITIONS}
    assert {r.run_id for r in found if r.rule == "activity_after_end"} == {f"{a}>{b}" for a, b in pairs if a in V.TERMINAL_STATES}


def test_problem_lists_are_cut_and_counted(spark):
    rows = [("r", f"/x/{i:03d}", "type") for i in range(120)] + [("v", "/schema_version", "const")]
    found = {r.run_id: r for r in problems(spark.createDataFrame(rows, "run_id string, pointer string, keyword string"), "problem").collect()}
    assert found["r"].total == 120 and [e.pointer for e in found["r"].errors] == [f"/x/{i:03d}" for i in range(50)]
    assert found["r"].detail == "Document does not satisfy contract 'problem': 120 violation(s), 50 reported."
    assert found["v"].code == "SCHEMA_VERSION_UNSUPPORTED"


def test_repeats_under_one_hot_key(spark):
    rows = [("r", i, "same" if i % 3 else f"k{i}") for i in range(3000)]
    found = repeats(spark.createDataFrame(rows, "run_id string, pos int, k string"), "c", "k", "once")
    assert found.count() == 2000 - 1 and found.where("pointer = '/c/1'").count() == 0


def test_robots_and_link_sources(spark):
    def robots(body, **given):
        return capture(SITE + "robots.txt", body=bytearray(body), content_type="text/plain", **given)

    rows = [
        robots(b"\xef\xbb\xbfSitemap: /a.xml\nsitemap:b.xml#c\n", run_id="r1"), robots(b"User-agent: *", run_id="r2"),
        robots(b" <!DOCTYPE HTML>", run_id="r3"), robots(b"a\x00b", run_id="r4"), robots(b"Sitemap: http://[", run_id="r5"),
        robots("Sitemap: /ä.xml".encode("latin-1"), run_id="r6", declared_charset="latin-1"),
        robots(b"Sitemap: /x\xff.xml", run_id="r7", truncated=True), robots(b"", run_id="r8", status_code=410),
    ]
    declared, attempts = discovery.robots_declarations(captures(spark, rows))
    assert {r.run_id: r.outcome for r in attempts.collect()} == {
        "r1": "USED", "r2": "NO_SITEMAP_DECLARATION", "r3": "MALFORMED", "r4": "MALFORMED", "r5": "MALFORMED", "r6": "USED",
        "r7": "BUDGET_EXHAUSTED", "r8": "ABSENT",
    }
    urls = [(r.run_id, r.declared_url) for r in declared.orderBy("run_id", "pos").collect()]
    assert urls == [
        ("r1", SITE + "a.xml"), ("r1", SITE + "b.xml"), ("r6", SITE + "ä.xml"), ("r7", SITE + "x�.xml"),
    ]
    html = b"".join(b"<a href=/p%d>l</a>" % (i % 4) for i in range(8)) + b"<a href=https://o.example/>o</a><a href=/p9>n</a>"
    seeds = captures(spark, [capture(SITE, body=bytearray(html))])
    seen, tried = discovery.seed_page_links(seeds)
    assert {r.observed_form for r in seen.collect()} == {SITE + f"p{i}" for i in (0, 1, 2, 3, 9)} and tried.first().outcome == "USED"
    seen, tried = discovery.seed_page_links(seeds, max_links=4)
    assert seen.count() == 4 and tried.first().outcome == "BUDGET_EXHAUSTED"


def test_streamed_captures_give_the_batch_result(spark, tmp_path):
    rows = captures(spark, [capture(SITE + str(i)) for i in range(20)])
    path = str(tmp_path / "captures")
    rows.repartition(4).write.parquet(path)
    got = []
    query = for_each_batch(
        measurement_stream(capture_stream(spark, path)), lambda df, _: got.extend(r.measurement_id for r in df.collect()),
        str(tmp_path / "checkpoint"),
    )
    query.awaitTermination()
    expected = measurements(observed_captures(read_captures(spark, path)))
    assert sorted(got) == sorted(r.measurement_id for r in expected.collect()) and len(got) == 260


def test_bundles_are_exclusive_and_read_back(spark, tmp_path):
    table = spark.createDataFrame([("r1", "a", None), ("r1", "b", True)], "run_id string, x string, y boolean")
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    bundle.write_bundle({"measurements": table}, folder)
    assert bundle.reconcile(spark, {"measurements": table}, folder).count() == 0
    with pytest.raises(FileExistsError):
        bundle.write_bundle({"measurements": table}, folder)
    other = table.withColumn("x", F.lit("c"))
    assert bundle.reconcile(spark, {"measurements": other}, folder).count() == 4


def test_malformed_lines_are_quarantined(spark, tmp_path):
    lines = ['{"a":1}', '{"a":NaN}', "nonsense", '{"a":"x"}', '{"a":2} tail', '{"b":1}']
    (tmp_path / "docs.json").write_text("\n".join(lines))
    documents, quarantine = read_documents(spark, str(tmp_path / "docs.json"), "a bigint")
    assert sorted((r.document.a is None, r.document.a) for r in documents.collect()) == [(False, 1), (True, None)]
    assert {r.text for r in quarantine.collect()} == set(lines) - {'{"a":1}', '{"b":1}'}


def test_digested_documents_hold_no_floats(spark):
    from pagecensus.operators.digests import floating_fields, list_fragments

    df = spark.createDataFrame([], "run_id string, a struct<b: array<double>, c: int>, m map<string, float>, n bigint")
    assert floating_fields(df.schema) == ["/a/b/*", "/m/*"]
    with pytest.raises(TypeError):
        list_fragments(df, [F.col("n")], F.to_json("a"))


def test_instants_do_not_depend_on_the_session_zone(spark):
    from pagecensus.functions.columns import instant

    moments = [0, 1767225600, 1774746000, 1774749600, -1, 253402300799]
    df = spark.createDataFrame([(m,) for m in moments], "m long").withColumn("t", F.timestamp_seconds("m"))
    want = ["1970-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "2026-03-29T01:00:00Z", "2026-03-29T02:00:00Z",
            "1969-12-31T23:59:59Z", "9999-12-31T23:59:59Z"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Europe/Berlin", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert [r.x for r in df.select("m", instant(F.col("t")).alias("x")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("ranges,part", [(1, 1 << 20), (7, 40), (40, 1)])
def test_documents_assembled_in_ranges(spark, monkeypatch, ranges, part):
    """Digests and texts do not depend on where ranges and parts of a document end."""


    monkeypatch.setattr(digests, "_TEXT_PART", part)
    rows, want = [], {}
    for d in range(9):
        pieces = [(0, "", 0, "", "L", "[")]
        text, items = "[", []
        for i in range(d * 7):
            inner = [f'"{i}-{j}"' for j in range(i % 4)]
            pieces.append((1, f"{i:04d}", 0, "", "O", '{"a":['))
            pieces += [(1, f"{i:04d}", 1, f"{j}", "I", t) for j, t in enumerate(inner)]
            pieces += [(1, f"{i:04d}", 2, "", "M", '],"b":['), (1, f"{i:04d}", 3, "é", "I", '"x"'), (1, f"{i:04d}", 4, "", "M", "]}")]
            items.append('{"a":[' + ",".join(inner) + '],"b":["x"]}')
        pieces += [(2, "", 0, "", "L", "],["), (3, "a", 0, "", "O", "1"), (3, "b", 0, "", "O", "2"), (4, "", 0, "", "L", "]")]
        text += ",".join(items) + "],[1,2]"
        want[f"doc{d}"] = text
        rows += [(f"doc{d}", s, k, p, i, "", kind, t) for s, k, p, i, kind, t in pieces]
    schema = "doc_id string, section int, key1 string, part int, key2 string, key3 string, kind string, text string"
    fragments = spark.createDataFrame(rows[::-1], schema)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = {r.doc_id: r.digest for r in digests.streamed_digests(fragments).collect()}
        texts = {}
        for r in sorted(digests.document_texts(fragments).collect(), key=lambda r: (r.doc_id, r.part_no)):
            assert r.part_no == len(texts.setdefault(r.doc_id, []))
            texts[r.doc_id].append(r.text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: "".join(v) for k, v in texts.items()} == want
    assert found == {k: "sha256:" + hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert digests.streamed_digests(fragments.limit(0)).collect() == []


def test_a_capture_without_a_time_is_a_capture(spark):
    captures = spark.createDataFrame(
        [("r", "https://s.example/a", None, 1), ("r", "https://s.example/b", None, 2), ("r", "https://s.example/b", 5, 3),
         ("r", "https://s.example/b#x", 5, 4), ("r", "https://s.example/c", 1, 5), ("q", "https://s.example/a", 1, 6)],
        "run_id string, requested_url string, at long, n int",
    ).withColumn("captured_at", F.timestamp_seconds("at"))
    selections = spark.createDataFrame([("r", "https://s.example/a"), ("r", "https://s.example/b")], "run_id string, url_key string")
    assert sorted(r.n for r in wanted_captures(selections, captures).collect()) == [1, 3, 4]


def followed(start, scope, hops, bound):
    """One chain, hop by hop."""
    from urllib.parse import urljoin

    at, count = start, 0
    while True:
        if (scope and not at.startswith(scope)) or not at.startswith("https://"):
            return "BLOCKED_TARGET", count, None
        if at not in hops:
            return "CONNECTION_FAILURE", count, None
        status, location = hops[at]
        if status not in V.REDIRECT_STATUSES:
            return "RESPONSE_RECEIVED", count, at
        if not (location or "").strip():
            return "INVALID_REDIRECT", count, None
        if bound == count or count >= len(hops):
            return "TOO_MANY_REDIRECTS", count, None
        at, count = urljoin(at, location.strip()), count + 1


def test_redirects_are_followed_by_doubling(spark):
    rng = random.Random(11)
    starts, hops, want = [], [], {}
    for chain in range(60):
        n = rng.choice([1, 2, 3, 7, 20])
        urls = [f"{SITE}u{i}" for i in range(n)]
        own = {}
        for i, url in enumerate(urls):
            kind = rng.random()
            to = urls[rng.randrange(n)] if kind < 0.15 else urls[i + 1] if i + 1 < n else None
            own[url] = (301, to) if to and kind < 0.92 else (200, None) if kind < 0.96 else (302, rng.choice([" ", "https://other.example/", f"{SITE}gone"]))
        scope = rng.choice([SITE, None])
        starts.append((str(chain), urls[0], scope))
        hops += [(str(chain), u, s, to) for u, (s, to) in own.items()]
        want[str(chain)] = (urls[0], scope, own)
    starts_df = spark.createDataFrame(starts, "chain_id string, url string, scope string")
    hops_df = spark.createDataFrame(hops, "chain_id string, url string, status int, location string")
    for bound in (None, 0, 3):
        got = {r.chain_id: (r.outcome, r.redirect_count, r.final_url) for r in targets.redirect_chains(starts_df, hops_df, bound).collect()}
        assert got == {c: followed(*w, bound) for c, w in want.items()}


def test_a_thousand_redirects_take_few_rounds(spark, monkeypatch):
    rounds = []
    doubled = targets._doubled
    monkeypatch.setattr(targets, "_doubled", lambda s: rounds.append(1) or doubled(s))
    hops = [("c", f"{SITE}{i}", 301, f"{SITE}{i + 1}") for i in range(1000)] + [("c", f"{SITE}1000", 200, None)]
    hops += [("d", f"{SITE}{i}", 301, f"{SITE}{(i + 1) % 1000}") for i in range(1000)]
    found = targets.redirect_chains(
        spark.createDataFrame([("c", f"{SITE}0", SITE), ("d", f"{SITE}0", SITE)], "chain_id string, url string, scope string"),
        spark.createDataFrame(hops, "chain_id string, url string, status int, location string"),
    )
    assert {(r.chain_id, r.outcome, r.redirect_count) for r in found.collect()} == {("c", "RESPONSE_RECEIVED", 1000), ("d", "TOO_MANY_REDIRECTS", 1000)}
    assert len(rounds) <= 11


def test_archives_show_whole_bundles_only(spark):
    root = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    table = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    schema = "run_id string, n int"
    assert archive.bundles(spark, root) == [] and archive.read_archive(spark, root, "a", schema).collect() == []
    first = archive.publish({"a": table, "b": table}, root, "2026-01-01", "x")
    archive.publish({"a": table.where("n = 1")}, root, "2026-01-02", "x")
    with pytest.raises(FileExistsError):
        archive.publish({"a": table}, root, "2026-01-01", "x")
    broken = table.withColumn("n", F.expr("raise_error('stopped')").cast("int"))
    with pytest.raises(Exception, match="stopped"):
        archive.publish({"a": table, "b": broken}, root, "2026-01-03", "x")
    table.write.json(f"{root}/_staging-of-a-writer-that-was-killed/a")
    assert [(d, n) for d, n, _ in archive.bundles(spark, root)] == [("2026-01-01", "x"), ("2026-01-02", "x")]
    found = archive.read_archive(spark, root, "a", schema)
    assert sorted((r.run_date, r.bundle, r.run_id, r.n) for r in found.collect()) == [
        ("2026-01-01", "x", "r1", 1), ("2026-01-01", "x", "r2", 2), ("2026-01-02", "x", "r1", 1)
    ]
    assert archive.unsound(spark, root).count() == 0
    table.write.mode("append").json(f"{first}/b")
    table.limit(1).write.mode("overwrite").json(f"{first}/a")
    assert {(r.dataset, r.problem) for r in archive.unsound(spark, root).collect()} == {("b", "unrecorded"), ("a", "missing"), ("a", "unrecorded")}
