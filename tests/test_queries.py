"""Every query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from hopweave.plans.catalog import ORACLES, QUERIES

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
