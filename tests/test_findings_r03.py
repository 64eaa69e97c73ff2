"""What the findings of the third round were about, one small case each."""

import hashlib

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from pagecensus.functions.content import in_slices
from pagecensus.functions import fixed_values as V
from pagecensus.operators import digests, lifecycle, receipts, targets
from pagecensus.operators.quality import documents as rules
from pagecensus.sources import bundle

SF = "/root/testdata/sf0.001"
RECORDS = """run_id string, acquisition_id string, url_key string, acquisition_outcome string, http_status bigint, final_url_key string,
    redirect_count bigint, body_truncated boolean, body_decoded boolean, body_digest string, measurement_refs array<string>,
    measurements_withheld_reason string"""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_that_grow_are_not_broadcast(spark, tmp_path):
    """an exploded table was taken for as small as what it is exploded from."""
    row = ("r", "a", "https://x/", "RESPONSE_RECEIVED", 200, "https://x/", 0, False, True, "d", ["m1", "m2"], None)
    spark.createDataFrame([row], RECORDS).write.parquet(f"{tmp_path}/r")
    records = spark.read.parquet(f"{tmp_path}/r")
    selections = records.selectExpr("run_id", "url_key", "1L as selection_rank")
    measured = records.selectExpr("run_id", "explode(measurement_refs) as measurement_id", "struct('WHY' as not_assessed_reason) as assessment")
    evidence = measured.selectExpr("run_id", "concat('e', measurement_id) as evidence_id", "array(measurement_id) as measurement_refs")
    found = receipts.page_receipts(records, selections, measured, evidence)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert [(r.selection_rank, r.evidence_refs, r.not_assessed_reasons) for r in found.collect()] == [(1, ["em1", "em2"], ["WHY"])]


def test_differences_are_found_in_one_aggregate(spark):
    """both directions in one pass, copies counted."""
    schema = "run_id string, n bigint, refs array<string>"
    was = spark.createDataFrame([("r", 1, ["a"])] * 3 + [("r", 2, None), ("s", 3, [])], schema)
    now = spark.createDataFrame([("r", 1, ["a"])] + [("r", 2, None), ("s", 4, [])] + [("t", 5, [])] * 2, schema)
    found = bundle.differences(was, now, "x")
    assert plan_of(found).count("HashAggregate") <= 2
    assert sorted((r.run_id, r.problem) for r in found.collect()) == [
        ("r", "missing"), ("r", "missing"), ("s", "missing"), ("s", "unexpected"), ("t", "unexpected"), ("t", "unexpected"),
    ]


def test_measurements_of_a_bundle_are_not_broadcast(spark, tmp_path):
    """the measurements a bundle's records name meet them by shuffles."""
    spark.createDataFrame([("r", 0, ["m1"], 1)], "run_id string, pos bigint, measurement_refs array<string>, n int").write.parquet(f"{tmp_path}/d")
    rows = spark.read.parquet(f"{tmp_path}/d")
    measured = rows.selectExpr("run_id", "pos", "explode(measurement_refs) as measurement_id")
    known = rules._owners(rows).select("run_id", "measurement_id")
    assert "BroadcastHashJoin" in plan_of(known.join(measured, ["run_id", "measurement_id"], "left_semi"))  # the case is one
    records = rows.selectExpr(
        "run_id", "pos", "measurement_refs", "'u' as url_key", "'a' as acquisition_id", "'m' as sampling_manifest_ref", "'d' as sampling_manifest_output_digest",
        "'o' as observation_mode", "'p' as acquisition_method", "'1' as acquisition_method_version", "string(null) as raw_artifact_ref",
        "string(null) as measurements_withheld_reason",
    )
    manifests = rows.selectExpr("run_id", "'m' as sampling_manifest_id", "'d' as output_digest")
    selections = rows.selectExpr("run_id", "'u' as url_key", "1L as selection_rank", "pos")
    evidence = rows.selectExpr("run_id", "pos", "measurement_refs", "string(null) as polarity")
    found = rules.acquisition(records, manifests, selections, measured, evidence)
    joins = [line for line in plan_of(found).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "measurement_id" in line]
    assert {r.rule for r in found.collect()} == {"record_declares_this_producer"}


def repeated_urls(folder):
    """Pages of which pairs share a URL and not their links, one a large page id."""
    con = duckdb.connect()
    con.execute(f"""copy (select page_id, url, html from '{SF}/pages.parquet' union all
        select a.page_id + 70000, b.url, a.html from '{SF}/pages.parquet' a join '{SF}/pages.parquet' b on b.page_id = (a.page_id + 1) % 20
        where a.page_id < 20) to '{folder}/pages.parquet' (format parquet)""")
    return str(folder)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["all_page_links", "link_budget", "site_discovery"])
def test_pages_with_one_url_have_their_own_links(spark, tmp_path, name):
    """the SQL gave the links of one page to all pages with its URL."""
    folder = repeated_urls(tmp_path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    df = entry.queries()[name](spark, folder)
    result = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in result.description], result.fetchall())


def test_private_addresses_of_large_page_ids(spark, tmp_path):
    """172.16.0.0/12 is reached by page 1052 first, four hex digits are exceeded by page 65536."""
    con = duckdb.connect()
    con.execute(f"""copy (select page_id + 1052 - page_id % 28 + k * 65536 as page_id, url, html from '{SF}/pages.parquet', range(3) t(k))
        to '{tmp_path}/pages.parquet' (format parquet)""")
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    df = entry.queries()["target_admissibility"](spark, str(tmp_path))
    result = con.execute(entry.oracle_sql()["target_admissibility"])
    assert table(df.columns, df.collect()) == table([d[0] for d in result.description], result.fetchall())


def fragments(documents, items, length):
    names = ["range", "doc_id", "kind", "text"]
    for d in documents:
        rows = [(0, d, "L", "[")] + [(0, d, "O", f"{i % 10}" * length) for i in range(items)] + [(0, d, "L", "]")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.string()] * 3])], names=names)


def test_rows_for_the_serial_hash_are_short():
    """F7, F8, F9: parts of a million characters and more met in one batch of thousands."""
    out = list(digests._assembled(True)(fragments(["a", "b", "c"], 5000, 600)))
    rows = [r for b in out for r in b.to_pylist()]
    assert max(len(r["text"] or "") for r in rows) <= 1 << 13
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in out) < 1 << 23
    long = [r for r in rows if r["whole"] is None]
    narrow = [pa.record_batch([pa.array([r[c] for r in long], pa.string()) for c in ("doc_id", "first", "last", "text")],
                              names=["doc_id", "first", "last", "text"])]
    text = "[" + ",".join(f"{i % 10}" * 600 for i in range(5000)) + "]"
    found = [r for b in digests._digest_batches(iter(narrow)) for r in b.to_pylist()]
    want = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert [(r["doc_id"], r["digest"]) for r in found if r["digest"] != want] == []
    assert len(found) + sum(r["whole"] is not None for r in rows) == 3


def test_a_batch_is_never_all_objects():
    """F10, F12, F16: what is read off ten thousand pages was held as objects until the batch was done."""

    class Facts(dict):
        alive = most = 0

        def __init__(self, *given):
            super().__init__(*given)
            Facts.alive += 1
            Facts.most = max(Facts.most, Facts.alive)

        def __del__(self):
            Facts.alive -= 1

    bodies = pa.array([str(i).encode() if i % 3 else None for i in range(1000)], pa.binary())
    kind = pa.struct([("x", pa.binary())])
    found = in_slices(lambda b, n: Facts({"x": b[:n]}), kind, bodies, pa.array([2] * 1000))
    assert found.to_pylist() == [{"x": str(i).encode()[:2]} if i % 3 else None for i in range(1000)]
    assert Facts.most <= 128
    assert in_slices(bytes, pa.binary(), pa.array([], pa.binary())).type == pa.binary()


def test_hops_are_not_broadcast(spark, tmp_path, monkeypatch):
    """the hops of all chains went through the driver, once a round."""
    plans = []
    kept = targets.materialised
    monkeypatch.setattr(targets, "materialised", lambda df: (plans.append(plan_of(df)), kept(df))[1])
    url = [f"https://x/{i}" for i in range(5)]
    hops = spark.createDataFrame([("c", u, 301, v) for u, v in zip(url, url[1:])] + [("c", url[4], 200, None)], "chain_id string, url string, status int, location string")
    starts = spark.createDataFrame([("c", url[0], "https://x/")], "chain_id string, url string, scope string")
    found = targets.redirect_chains(starts, hops)
    assert not [p for p in [*plans, plan_of(found)] if "BroadcastHashJoin" in p]
    assert [(r.final_url, r.redirect_count) for r in found.collect()] == [(url[4], 4)]


def broadcast_rows(plan):
    """Rows of each broadcast of a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return broadcast_rows(plan.executedPlan())
    if "QueryStage" in name:
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for i in range(plan.children().size()) for n in broadcast_rows(plan.children().apply(i))]


def test_state_histories_are_not_broadcast(spark):
    """every row met its predecessor by a broadcast of all rows, as long as their file was small."""
    tokens = [*V.RUN_STATES, "LOST", None]
    histories = {f"r{i}": [tokens[(i * j + j // 3) % 8] for j in range(3)] for i in range(200)}
    histories |= {"hot": [tokens[0 if i < 1200 else i % 8] for i in range(2000)], None: ["CREATED", "QUEUED", "RUNNING", "FAILED"] * 100}
    expected = []
    for run, states in histories.items():
        ended = False
        for i, (before, state) in enumerate(zip([None, *states], states)):
            legal = state == "CREATED" if before is None else (before, state) in V.LEGAL_TRANSITIONS
            known = state in V.RUN_STATES and before in [None, *V.RUN_STATES]
            rules = ["unknown_state"] * (state == "LOST") + ["illegal_transition"] * (known and not legal) + ["activity_after_end"] * ended
            expected += [(str(run), i + 1, str(before), str(state), rule) for rule in rules]
            ended = ended or state in V.TERMINAL_STATES
    rows = [(run, i, state) for run, states in histories.items() for i, state in enumerate(states)]
    found = lifecycle.audit(spark.createDataFrame(rows[::-1], "run_id string, seq int, state string"), ["seq"])
    got = sorted((str(r.run_id), r.place, str(r.previous), str(r.state), r.rule) for r in found.collect())
    assert got == sorted(expected)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(broadcast_rows(found._jdf.queryExecution().executedPlan())) <= max(ranges, len(V.LEGAL_TRANSITIONS))
