"""Every registered query beside its SQL on the smallest tables."""

import pytest

import check
from evidex.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    ok, note, *_ = check.compare(spark, con, SF_DIR, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert ok, note


def test_every_query_has_its_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
