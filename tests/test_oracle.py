"""Every registered query against its SQL twin."""

import check
import pytest

from tillbook.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_agrees(spark, database, name):
    good, note = check.compare(spark, database, FOLDER, name)
    assert good, note
