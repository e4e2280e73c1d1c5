"""Queries against their SQL twins. ``TABKIT_CHECK=all`` runs every query, else a quick choice."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bindings.oracles import ORACLES
from bindings.queries import QUERIES
from check_oracle import compare

QUICK = """group_center_top10 frequency_table missing_report numeric_profile above_at_below price_change_buckets
date_order_counts resample_monthly row_ledger timeline_flags price_features_listed iqr_fences outlier_flags
closed_month_pages""".split()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 25


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TABKIT_CHECK") == "all" else QUICK)
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name) is None
