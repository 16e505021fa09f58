"""Every registered query against its SQL, on the smallest test folder."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from conftest import SF
from millwatch.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem, _ = compare(spark, duck, SF, QUERIES[name], ORACLES.get(name))
    assert problem == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


INVENTORY = (
    [f"s{i}" for i in range(1, 10)] + [f"p{i}" for i in range(1, 14)] + [f"j{i}" for i in range(1, 13)]
    + [f"a{i}" for i in range(1, 18)] + [f"w{i}" for i in range(1, 6)] + [f"l{i}" for i in range(1, 5)] + ["u1", "u2"]
    + [f"f{i}" for i in range(1, 17)] + [f"t{i}" for i in range(1, 7)] + [f"m{i}" for i in range(1, 10)] + ["x1", "x2"]
)


def test_inventory_is_covered():
    """The 95 operators of the survey each have a query."""
    assert len(INVENTORY) == 95
    assert [i for i in INVENTORY if not any(name.startswith(f"{i}_") for name in QUERIES)] == []
