"""The named queries against their SQL oracles on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle_compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Long reports over many codecs; their parts are tested on their own.
SLOW = {"method_table", "dimension_sweep", "trial_comparison", "tier_matrix", "rate_crossover"}


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    _, rows, verdict = compare(spark, duck, "sf0.001", name, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows only")) and "TYPES" not in verdict, verdict
