"""Plans of statement results do not grow with the statements."""

from __future__ import annotations

import pytest

from querymill.operators import execute as X
from querymill.plans import registry

QUERIES = ["contrast_groups", "execution_scores", "meaningless_statements", "statement_kinds"]


@pytest.mark.parametrize("name", QUERIES)
def test_plans_hold_no_statements(spark, data, name, monkeypatch):
    """The driver ran out of memory over plans with some expressions for each statement."""
    sizes, kept = [], X.materialize

    def measured(df, to):
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        return kept(df, to)

    monkeypatch.setattr(X, "materialize", measured)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        assert registry.queries()[name](spark, data).count() > 0
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sizes and max(sizes) < 100_000, sizes
