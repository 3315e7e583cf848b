"""What the physical plans of the queries of this subpackage must not contain."""

import pytest

from catalith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cartesian_product_and_no_row_udf(spark, sf, name):
    text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text  # Arrow only
