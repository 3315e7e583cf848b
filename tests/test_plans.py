"""What the physical plans of the queries must and must not contain."""

import pytest

from catalith.plans import registry

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cartesian_product_and_no_row_udf(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text  # Arrow only


def test_scans_read_only_what_they_need(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(registry.queries()["p6_found"](spark, sf))
    assert "job_data" not in text and "size_bytes" not in text and "next_retry_at" not in text
    text = plan(registry.queries()["cluster_asset_counts"](spark, sf))
    assert "embedding" not in text and "centroid" not in text
    text = plan(registry.queries()["filter_owner_tags"](spark, sf))
    assert "EqualTo(owner,team-slate-press)" in text and "EqualTo(status,done)" in text  # pushed to the scan


def test_every_query_has_sql_or_a_reason():
    without = set(registry.queries()) - set(registry.sql())
    assert without == {"leader_clustering", "recursive_chunks", "document_chunks", "json_registered", "p2_items", "p2_hosts", "p3_found", "p3_reasons", "p5_found", "p5_table", "field_samples", "picture_hashes", "diverse_frames", "neighbours_recall"}
