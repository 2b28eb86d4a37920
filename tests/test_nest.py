"""Nested fixtures: what they shuffle, and that the number of parts changes no result."""

import pytest

from lamella import queries as core
from lamella.operators import nest
from lamella.queries import FIXTURES


def test_customers_shuffle_their_own_fields_alone(spark, tiny):
    plan = FIXTURES["customers"][0](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan and "l_suppkey" in plan  # which only orders the items
    assert not [c for c in ("l_discount", "l_shipdate", "l_returnflag", "o_orderdate", "o_orderpriority") if c in plan]


@pytest.mark.parametrize("name", ["customers", "line_items"])
def test_dealt_into_parts_by_size(spark, tiny, monkeypatch, name):
    """Large tables are dealt into parts by the size of their files, with the same records."""
    make = FIXTURES[name][0]
    plain = make(spark, tiny)
    rows = sorted(map(repr, plain.collect()))
    monkeypatch.setattr(nest, "PART_BYTES", 4096)
    some = make(spark, tiny)
    assert some.rdd.getNumPartitions() >= 16 and some.schema == plain.schema
    assert sorted(map(repr, some.collect())) == rows


def test_groups_hold_a_value_once(spark):
    """What orders a group's rows is not collected twice, and fields come in the order asked for."""
    df = spark.createDataFrame([(1, 2, "b", 5), (1, 1, "c", 6), (1, 1, "a", 7), (2, None, None, None)], "k long, o long, x string, y long")
    found = nest.group(df, "k", ["o"], "rows", ["x", "o"])
    assert {r["k"]: [tuple(e) for e in r["rows"]] for r in found.collect()} == {1: [("a", 1), ("c", 1), ("b", 2)], 2: [(None, None)]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_row") == 0
