import pytest
from pulsegrid.plans import data_quality, reference

from .oracle import same

ALL = {k: (f, m.oracle_sql().get(k)) for m in (reference, data_quality) for k, f in m.queries().items()}


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if sql))
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, *ALL[name])


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if not sql))
def test_runs(spark, sf_dir, name):
    assert ALL[name][0](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
