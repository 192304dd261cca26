import pytest
from pulsegrid.llm import queries as M

from ..oracle import same


@pytest.mark.parametrize("name", sorted(M.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, M.queries()[name], M.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(M.queries()) - set(M.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert M.queries()[name](spark, sf_dir).count() > 0
