"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import compare
import pytest

from lakequill.plans import catalog


@pytest.fixture(scope="session")
def con(data_dir):
    return compare.connect(data_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, data_dir, con, name):
    assert not compare.difference(catalog.queries()[name](spark, data_dir), con, catalog.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_gives_rows(spark, data_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "hybrid_score", "lang"] and df.count() == 8


def test_filters_reach_the_scan(spark, data_dir):
    plan = catalog.queries()["filter_numeric"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_quantity" in plan and "l_extendedprice" not in plan


def test_topk_doesn_t_sort_all_rows(spark, data_dir):
    plan = catalog.queries()["vector_topk"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
