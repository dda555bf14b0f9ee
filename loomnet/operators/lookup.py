"""Read-only queries on finished networks and modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.plans.runtime import materialize


def genes_of_modules(genes: DataFrame, modules: list[str]) -> DataFrame:
    """Gene-info rows of exactly these modules."""
    return genes.where(F.col("module").isin(list(modules)))


def modules_of_genes(genes: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """(gene_id, module) of the wanted genes: a list, or a table (gene_id) of any size."""
    if isinstance(ids, DataFrame):
        return genes.join(ids.select("gene_id").distinct(), "gene_id", "left_semi").select("gene_id", "module")
    return genes.where(F.col("gene_id").isin(list(ids))).select("gene_id", "module")


def module_names(genes: DataFrame) -> DataFrame:
    return genes.select("module").distinct().orderBy("module")


def filter_attributes(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Rows with a listed value in every named column."""
    for column, values in filters.items():
        df = df.where(F.col(column).isin(list(values)))
    return df


def top_kme(kme: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """The n genes of each module with the largest membership in it."""
    own = kme.join(genes.select("gene_id", "module"), ["gene_id", "module"])
    nth = F.row_number().over(W.partitionBy("module").orderBy(F.desc(F.round("r", 9)), "gene_id"))
    return own.withColumn("rank", nth).where(F.col("rank") <= n)


def subnetwork(tom: DataFrame | Callable[[DataFrame], DataFrame], kme: DataFrame, genes: DataFrame, modules: list[str], n_genes: int = 10, n_edges: int = 100, min_tom: float = 0.0, filters: dict[str, list] | None = None, with_edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, edges) of the best connected genes of some modules: top genes by membership, their overlaps of at least min_tom, the n_edges largest.

    ``tom`` is a table of overlaps, or makes one for the genes that it gets (gene_id), so that those of all pairs aren't needed. ``with_edges=False``: edges are None and no
    overlap is made. Nodes carry what a plot needs: label, color (the module's), shape and a title with all that is known of the gene."""
    chosen = filter_attributes(genes_of_modules(genes, modules), filters or {})
    info = [c for c in genes.columns if c not in ("gene_id", "module")]
    title = F.concat_ws("\n", F.col("gene_id"), *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in info])
    told = chosen.select("gene_id", title.alias("title"))
    nodes = top_kme(kme, chosen, n_genes).join(told, "gene_id").select("gene_id", F.col("gene_id").alias("label"), "module", F.col("module").alias("color"), F.lit("dot").alias("shape"), "title", "r", "rank")
    if not with_edges:
        return nodes, None
    if callable(tom):
        nodes = materialize(nodes, "nodes")
        tom = tom(nodes.select("gene_id"))
    ids = nodes.select("gene_id")
    inside = tom.join(ids.withColumnRenamed("gene_id", "i"), "i", "left_semi").join(ids.withColumnRenamed("gene_id", "j"), "j", "left_semi")
    edges = inside.where((F.col("t") >= min_tom) & (F.col("t") != 0)).orderBy(F.desc(F.round("t", 9)), "i", "j").limit(n_edges)
    return nodes, edges


def power_plot(table: DataFrame) -> DataFrame:
    """Plot data of the power scan: the fit signed by the slope, and mean connectivity."""
    return table.select("power", (-F.signum("slope") * F.col("r_sq")).alias("signed_r_sq"), "mean_k")


def partners(edges: DataFrame, genes: DataFrame, limit: int = 5) -> DataFrame:
    """(gene1, gene2, score): the ``limit`` best-scored partners of each wanted gene, from a table of interactions."""
    wanted = edges.join(genes.select(F.col("gene_id").alias("gene1")).distinct(), "gene1", "left_semi")
    nth = F.row_number().over(W.partitionBy("gene1").orderBy(F.desc("score"), "gene2"))
    return wanted.withColumn("nth", nth).where(F.col("nth") <= limit).select("gene1", "gene2", "score")
