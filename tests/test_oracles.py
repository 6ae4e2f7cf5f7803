"""Registered queries against DuckDB at the smallest scale. ``LEAFSCORE_ALL=1`` runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from leafscore.plans.views import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "cer", "wer", "char_ned", "normalize_text", "normalize_field", "field_prf", "corpus_eval", "condition_kie_summary", "recovery_grid", "curve_jump_abs",
    "matrix_expand", "ops_overview", "ops_decision_reasons", "feedback_funnel", "feedback_reason_field", "improve_by_confidence", "signals", "extract_date",
    "extract_total", "extract_company", "reading_order_fast", "validate_document", "decide", "explain_decision", "derive_issues", "unique_actions", "audit_report",
    "degrade_text", "restore_text", "batch_lifecycle", "stream_daily_kpis",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("LEAFSCORE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 180
