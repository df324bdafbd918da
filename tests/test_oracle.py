"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from tidemark.registry import registered

#: So few rows of the smallest tables fit these that there may be none.
MAY_BE_EMPTY = {"j6_claimable_runs", "f2_search_phrase", "f1_filtered", "o1_page_of_jobs", "j1_jobs_for_run", "s6_quarantined", "o4_list_schedules", "k4_due_runs", "t1_streamed_log", "j2_new_in_latest_run"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, (_, sql) in registered().items() if sql])
def test_query(spark, con, sf_dir, name):
    make, sql = registered()[name]
    found = compare(spark, con, sf_dir, make, sql)
    assert found is None or (name in MAY_BE_EMPTY and found == "no rows on either side")


@pytest.mark.parametrize("name", [n for n, (_, sql) in registered().items() if not sql])
def test_query_without_sql(spark, sf_dir, name):
    assert registered()[name][0](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
