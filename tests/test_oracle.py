"""Every core query against its SQL on the smallest tables."""

import pytest

from tessera.plans.oracle import SQL
from tessera.plans.queries import Q


@pytest.mark.parametrize("name", [n for n in Q if n in SQL])
def test_same_rows(same, name):
    same(Q[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in Q if n not in SQL])
def test_runs(spark, data, name):
    assert Q[name](spark, data).count() > 0


def test_entry_names_match():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
