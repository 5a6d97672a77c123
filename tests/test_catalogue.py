"""Every query of the catalogue against its SQL."""

import pytest
from harness import compare

from quorumlens.plans import catalogue, files, members, more, rounds  # noqa: F401  each registers its queries


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) >= 0
    spark.catalog.clearCache()


def test_planner_over_a_grid(spark):
    rows = more.planner_decisions(spark, "").collect()
    assert len(rows) == 6 * 6 * 2 * 3 - 6 * 2
    assert all(r.reason == "Ready" for r in rows if r.c == 0 and r.s == r.desired)
    assert all((r.action, r.to_size) == ("ScaleStatefulSet", r.s + 1) for r in rows if r.c == 1)
