import pytest

from candlemill import registry
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    columns, want = duck(SF, registry.oracle_sql()[name])
    got_columns, got = spark_rows(registry.queries()[name](spark, SF))
    assert got_columns == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
