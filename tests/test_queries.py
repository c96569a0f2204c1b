import pytest

import __spark_entry__ as entry
import check
from rowloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    count, problem = check.difference(spark, db, sf_dir, name)
    assert not problem, problem


