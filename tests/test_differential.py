"""Every query outside the corpus subpackage against its SQL, on the smallest tables."""

import pytest
from differential import connect, differences

from millrace.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, duck, name):
    found = [d for d in differences(QUERIES[name](spark, SMALL), duck, ORACLES[name]) if "decimal" not in d]
    assert not found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_approximations_are_near(spark, duck):
    got = {r["o_orderstatus"]: r["customers"] for r in QUERIES["agg_approx_distinct"](spark, SMALL).collect()}
    want = dict(duck.execute("select o_orderstatus, count(distinct o_custkey) from orders group by 1").fetchall())
    assert all(abs(got[k] - n) <= 0.1 * n for k, n in want.items())
    prices = {r["l_returnflag"]: r["prices"] for r in QUERIES["agg_approx_percentile"](spark, SMALL).collect()}
    for flag, a, b in duck.execute("select l_returnflag, quantile_disc(l_extendedprice, 0.49), quantile_disc(l_extendedprice, 0.51) from lineitem group by 1").fetchall():
        assert a <= prices[flag][0] <= b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
