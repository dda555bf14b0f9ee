"""Plans for many genes against those for few: pairs stay in the tasks that make them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomnet.operators import components, network
from loomnet.plans import queries
from loomnet.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def values(df):
    keys = [c for c, kind in df.dtypes if kind != "double"]
    return {tuple(row[k] for k in keys): [row[c] for c in df.columns if c not in keys] for row in df.collect()}


def same(a, b):
    assert set(a) == set(b) and a
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=2e-6), k


@pytest.fixture
def many(monkeypatch):
    """As if all tables had many genes: several blocks, several strips of each."""
    for module in (network, components):
        monkeypatch.setattr(module, "BLOCK_FROM", 3)
        monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(network, "PAIRS", 9)
    return monkeypatch


def no_pairs(monkeypatch):
    """Makes every way of writing pairs down an error."""

    def refuse(*_, **__):
        raise AssertionError("pairs are written")

    for name in ("mirrored", "block_products", "adjacency"):
        monkeypatch.setattr(network, name, refuse)


def above_the_tasks(df):
    """The part of a plan that gets the pairs."""
    return plan(df).split("FlatMapGroupsInArrow")[0]


PAIRS = ["n1_correlation", "n1_correlation_block", "n2_adjacency_hybrid", "n2_adjacency_signed", "n2_adjacency_unsigned", "n1_correlation_gaps", "n1_weighted_gaps", "n1_weighted_correlation", "n2_adjacency_selected"]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_are_never_joined_or_sent(many, spark, name):
    assert not re.search("Join|Exchange", above_the_tasks(queries.QUERIES[name](spark, SF)))


def test_a_row_goes_to_few_blocks():
    """Rows are sent once a block: at 60,000 genes 118 times before."""
    for genes in (1_000, 60_000, 360_000):
        blocks = -(-genes // network.block_rows(83, genes))
        assert blocks <= max(network.BLOCKS + 1, genes // network.LARGE + 1)
    assert network.block_rows(60_000, 60_000) * 60_000 <= network.CELLS  # wide rows stay in few


@pytest.mark.parametrize("kind", ["unsigned", "signed", "signed hybrid"])
@pytest.mark.parametrize("gaps", [False, True])
def test_sums_by_power(many, spark, kind, gaps):
    expr = (fx.events if gaps else fx.supp)(spark, SF)
    few = network.power_connectivity(network.correlation(expr, "join"), (1, 2, 4.5, 3), kind)
    want = values(few)
    no_pairs(many)
    same(values(network.connectivity_by_power(expr, (1, 2, 4.5, 3), kind)), want)


@pytest.mark.parametrize("name", ["n3_soft_threshold", "n3_picked_power", "n4_scale_free_fit", "n5_network_concepts", "v1_power_plot", "n8_soft_connectivity", "n10_intramodular", "n11_hub_genes", "n0_checked_matrix", "s14_subnetwork_nodes"])
def test_sums_need_no_pairs(many, spark, name):
    if name in ("n8_soft_connectivity", "n11_hub_genes"):  # 500 vectors: cut less fine
        for k, v in (("BLOCK", 200), ("PAIRS", 3000)):
            many.setattr(network, k, v)
    many.setattr(network, "BLOCK_FROM", 1000)
    want = values(queries.QUERIES[name](spark, SF))
    many.setattr(network, "BLOCK_FROM", 3)
    no_pairs(many)
    same(values(queries.QUERIES[name](spark, SF)), want)


def flat_and_apart(spark):
    """Ten genes, some without spread, two that share no sample."""
    x = np.random.default_rng(5).normal(size=(10, 12))
    x[3], x[7] = 2.5, 1.0
    x[0, :6], x[1, 6:] = np.nan, np.nan
    return spark.createDataFrame([(f"s{s}", f"g{g}", float(v)) for (g, s), v in np.ndenumerate(x) if not np.isnan(v)], "sample_id string, gene_id string, value double")


def test_genes_without_spread_or_shared_samples(many, spark):
    expr = flat_and_apart(spark)
    same(values(network.correlation(expr)), values(network.correlation(expr, "join")))
    full = expr.where("gene_id > 'g1'")
    same(values(network.correlation(full)), values(network.correlation(full, "join")))
    genes = expr.select("gene_id", F.concat(F.lit("m"), F.col("gene_id") > "g4").alias("module")).distinct()
    want = network.intramodular(network.adjacency(network.correlation(expr, "join"), "signed", 3), genes)
    same(values(network.intramodular_of(expr, genes, "signed", 3)), values(want))
    same(values(network.hub_genes_of(expr, genes, "signed", 3, 2)), values(network.hub_genes(network.adjacency(network.correlation(expr, "join"), "signed", 3), genes, 2)))


def test_overlap_of_chosen_genes(many, spark):
    expr = flat_and_apart(spark)
    ids = spark.createDataFrame([("g2",), ("g5",), ("g8",), ("g3",)], "gene_id string")
    every = values(network.tom(network.adjacency(network.correlation(expr, "join"), "signed", 3), plan="join"))
    wanted = {"g2", "g3", "g5", "g8"}
    same(values(network.tom_among(expr, ids, "signed", 3)), {k: v for k, v in every.items() if set(k) <= wanted})


def test_subnetwork_edges_need_no_other_overlaps(many, spark):
    want = values(queries.QUERIES["n9_subnetwork_edges"](spark, SF))

    def refuse(*_, **__):
        raise AssertionError("overlaps of all pairs")

    for name in ("tom", "block_products"):
        many.setattr(network, name, refuse)
    same(values(queries.QUERIES["n9_subnetwork_edges"](spark, SF)), want)


def test_hub_profile_by_blocks(many, spark):
    many.setattr(components, "BLOCK_FROM", 1000)
    want = values(queries.QUERIES["m2_hub_profile"](spark, SF))
    many.setattr(components, "BLOCK_FROM", 3)
    assert "FlatMapGroupsInArrow" in plan(components._covariance_sums(network.zscores(fx.events(spark, SF)).withColumn("module", F.lit("m")).where("value is not null"), 6))
    same(values(queries.QUERIES["m2_hub_profile"](spark, SF)), want)


def test_imputation_by_blocks_of_givers(spark, monkeypatch):
    """Blocks of givers have a size of their own; however many there are, the values are the same."""
    expr = spark.range(600 * 12).select(F.concat(F.lit("s"), F.col("id") % 12).alias("sample_id"), F.concat(F.lit("g"), F.floor(F.col("id") / 12)).alias("gene_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"))
    expr = expr.where("not (sample_id = 's3' and gene_id in ('g5', 'g77'))")
    genes = expr.select("gene_id", F.lit("m").alias("module")).distinct()
    filled = lambda: values(components.impute_nearest(expr, genes, 10).where("sample_id = 's3' and gene_id in ('g5', 'g77')"))
    want = filled()
    assert len(want) == 2
    monkeypatch.setattr(components, "GIVERS", 0.05)
    same(filled(), want)
