"""Queries against their SQL. A sample runs by default; ALL_QUERIES=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .check import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["score_postings", "extract_experience", "dedup_exact_key", "upsert_merge_exact",
          "html_detail", "page_yield", "feed_page", "stats_dashboard", "topk_per_candidate",
          "profile_reply_or_rules"]
NAMES = sorted(queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df, sql = queries()[name](spark, SF_DIR), oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        same, note = compare(df, duck, sql)
        assert same, note
