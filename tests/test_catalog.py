"""Every named query against its SQL on the smallest tables."""

import harness
import pytest

from tamis.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    return harness.database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, db, name):
    assert harness.differences(catalog.queries()[name](spark, sf_dir), db, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
