"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from workload.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert difference(ours, database.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 25
