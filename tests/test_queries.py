"""Every registered query on the smallest tables, against its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, duck  # noqa: E402
from shelfprice import plans  # noqa: E402

# the text operators, where they are installed, have tests of their own
PLANS, CHECKS = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(request):
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in PLANS if n in CHECKS])
def test_query_equals_sql(spark, con, folder, name):
    got = PLANS[name](spark, folder).toPandas()
    assert compare(got, con.execute(CHECKS[name]).fetchdf()) == "ok"


#: Cross-validated fits of full-size models, several minutes each also on the smallest tables; their parts are tested
#: with small models in test_models.py, that they ask for the full sizes in test_model_queries.py.
SLOW = {"demand_models", "model_comparison"}
RUN_SLOW = pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="set SLOW_TESTS to fit full-size models with folds")


@pytest.mark.parametrize("name", [pytest.param(n, marks=RUN_SLOW) if n in SLOW else n for n in PLANS if n not in CHECKS])
def test_query_has_rows(spark, folder, name):
    assert PLANS[name](spark, folder).count() > 0


def test_entry_registers_all(spark):
    assert set(PLANS) <= set(entry.queries()) and CHECKS.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert {"product_id", "recommended_price", "change_pct"} <= set(entry.entry(spark).columns)


def test_text_outputs(spark, folder):
    from shelfprice.operators import analytics, recommend
    from shelfprice.sources import retail

    cells = analytics.catalogue_cells(retail.lines(spark, folder), retail.products(spark, folder))
    prices = recommend.recommend(retail.pricing_rows(spark, folder)).where("supported")
    story = analytics.insight(cells, prices).first()["story"]
    assert "highest profit" in story and "Sales peak in" in story
