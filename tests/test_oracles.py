"""A cross-section of the registered queries against DuckDB on the smallest tables.

``python check_oracles.py`` runs all of them.
"""

import pytest

import __spark_entry__ as entrypoint
import check_oracles

SAMPLE = [
    "scan_journal", "scan_catalogs", "clean_journal", "check_daily_rules", "check_labels", "join_intraday", "population_filter",
    "reconcile_tables", "asof_problems", "year_summary", "month_hour_weekday", "dimension_summary", "correlation_matrix",
    "psi", "ks_statistic", "rolling_sums", "others_in_group", "carry_last", "context_memory", "recurrence",
    "object_features", "onset_features", "episode_labels", "markov_forecast", "seasonal_forecast", "sequence_windows",
    "review_queue", "inverse_weights", "roc_auc", "slice_metrics", "episode_metrics", "spline_basis", "build_cards",
    "validate_release", "check_facts", "recommend", "future_mutation", "tagged_log_union",
]


@pytest.fixture(scope="module")
def duck(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, sf, name):
    ok, text = check_oracles.compare(spark, duck, name, sf)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_entry_returns_ranked_objects(spark):
    df = entrypoint.entry(spark)
    assert "rank" in df.columns and df.count() > 0
