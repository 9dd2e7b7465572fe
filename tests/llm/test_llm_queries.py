import pytest
import support

from docloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert support.differences(QUERIES[name](spark, support.SMALL), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_on_every_row(spark, name):
    table = "pages" if name.startswith("op6") else "documents"
    got = QUERIES[name](spark, support.SMALL)
    assert name.startswith("op8") or got.count() == spark.read.parquet(f"{support.SMALL}/{table}.parquet").count()
