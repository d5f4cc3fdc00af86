"""A spread of registered queries against SQL; ``compare.py`` runs them all."""

import pytest

import __spark_entry__ as entry
import compare

CHECKED = ("parse_mixed_dates", "age_with_unit", "clean_coordinates", "normalise_places", "validation_issues",
           "dedup_merge", "geocode_cascade", "facility_clusters", "weekly_alerts_regions", "delay_stats")


@pytest.fixture(scope="module")
def con(small_dir):
    return compare.connect(small_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, small_dir, name):
    assert compare.difference(entry.queries()[name](spark, small_dir), con, entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
