"""Plans: narrow scans, pushed filters, no nested-loop joins over genes, no Python where functions suffice."""

import re

import pytest

from loomnet.operators import lookup, network
from loomnet.plans import fixtures as fx
from loomnet.plans import queries

SF = "/root/testdata/sf0.001"
PYTHON = {"c1_distance", "n1_correlation_block", "n6_tom_mean_block", "m2_eigengene", "m2_variance_explained", "m4_multiset_eigengenes", "m10_merge", "n1_correlation_gaps", "n1_weighted_gaps", "n2_adjacency_selected", "n6_tom_tiles", "m2_component_by_blocks", "m2_three_components", "m2_imputed", "s1_csv_scan", "s3_sparse_matrix"}
LOOPS = {"p4_good_samples_genes", "p4_weighted_good_samples_genes", "p5_outlying_samples", "c2_linkage", "c3_static_cut", "c6_module_detection", "m9_module_order", "m9_consensus_order", "c4_heatmap_rows", "c2_spanning_tree", "m10_consensus_round", "m10_consensus_merge"}  # results are read from tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - PYTHON - LOOPS))
def test_no_python_in_native_queries(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["n1_correlation", "n2_adjacency_hybrid", "n3_soft_threshold", "n8_soft_connectivity", "n10_intramodular", "n12_signed_kme", "t2_module_trait"])
def test_pairs_are_equality_joins(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    loops = text.count("BroadcastNestedLoopJoin") + text.count("CartesianProduct")
    # only the grid of suppliers and months, whose empty cells are zeros, is a product
    assert loops <= text.count("l_suppkey") and (loops == 0 or "l_suppkey" in text)


def test_filters_and_columns_reach_the_scan(spark):
    customers = fx.read(spark, SF, "customer")
    text = plan(lookup.filter_attributes(customers, {"c_mktsegment": ["BUILDING"]}).select("c_custkey"))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan(fx.emb(spark, SF))


def test_power_scan_is_one_aggregation(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5)], "i string, j string, r double")
    text = plan(network.power_connectivity(pairs, (1, 2, 3)))
    assert text.count("Exchange hashpartitioning") == 1


def test_sums_are_combined_before_the_shuffle(spark):
    text = plan(network.connectivity(spark.createDataFrame([("a", "b", 0.5)], "i string, j string, a double")))
    assert "partial_sum" in text
