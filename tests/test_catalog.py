"""Every named query equals its SQL in DuckDB."""
import pytest

from claimlake.plans.catalog import QUERIES
from claimlake.plans.oracle import ORACLE
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, ORACLE[name]) == ""


# Operators with helpers for hot keys, run as if every key were hot.
HOT = ["apply_commands", "commanded_claims", "revise_sources", "allocate_ids", "ingest_sources", "project_docs", "create_pages",
       "find_similar", "lint_duplicate_claim", "lint_duplicate_id", "lint_quote_not_in_source", "inbox_classify", "recapture",
       "check_quotes", "quote_audit", "review_marks", "create_items", "competition_rank", "triage",
       "inherit_sensitivity", "derived_leak", "lint_dangling_ref", "similar_members", "one_hop"]


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_change_nothing(spark, folder, con, hot, name):
    hot(3)
    assert difference(QUERIES[name](spark, folder), con, ORACLE[name]) == ""
