"""Every catalogue query against its SQL twin."""

from __future__ import annotations

import pytest
from same import same

from folioforge.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, data, duck, name):
    same(catalogue.queries()[name](spark, data), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    assert df.columns and len(df.collect()) >= (name != "greedy_pairs")  # the smallest tables may have no pair to match


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
