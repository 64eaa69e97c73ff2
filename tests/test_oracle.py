"""Registered queries against their SQL on DuckDB; tools/check_oracle.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from pagecensus.catalog.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "url_identity", "page_links", "census_budgeted", "census_completeness", "page_observations", "homepage_measurements",
    "findings", "dq_manifest_semantics", "dq_acquisition", "lifecycle_audit", "structure_measurement_record",
    "structure_site_inventory", "target_admissibility", "redirect_chains", "json_quarantine", "capture_normalisation",
]


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for given in ("pages", "events"):
        con.execute(f"create view {given} as select * from '{SF}/{given}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in result.description], result.fetchall())
