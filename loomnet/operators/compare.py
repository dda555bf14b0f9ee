"""Comparison of module assignments between networks, and over-representation of gene sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.functions.stats import benjamini_hochberg, hypergeometric_p, jaccard, minus_log10


def membership_union(networks: dict[str, DataFrame]) -> DataFrame:
    """membership(network, module, gene_id) from several (gene_id, module) tables."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("network"), "module", "gene_id") for name, df in networks.items()))


def compare_networks(membership: DataFrame, alternative: str = "greater") -> DataFrame:
    """(network1, module1, network2, module2, size1, size2, inter, jaccard, fraction, p) for all modules of different networks, in both orders.

    Overlaps come from one join on the gene; module pairs without a shared gene are there with 0. fraction is of module 2; p is Fisher's, against the union
    of all networks' genes."""
    membership = membership.select("network", "module", "gene_id").where("gene_id is not null").distinct()
    sizes = membership.groupBy("network", "module").agg(F.count(F.lit(1)).alias("size"))
    n = membership.agg(F.countDistinct("gene_id").alias("n"))
    a = membership.select("gene_id", F.col("network").alias("network1"), F.col("module").alias("module1"))
    b = membership.select("gene_id", F.col("network").alias("network2"), F.col("module").alias("module2"))
    shared = a.join(b, "gene_id").where("network1 <> network2").groupBy("network1", "module1", "network2", "module2").agg(F.count(F.lit(1)).alias("inter"))
    s1 = sizes.select(F.col("network").alias("network1"), F.col("module").alias("module1"), F.col("size").alias("size1"))
    s2 = sizes.select(F.col("network").alias("network2"), F.col("module").alias("module2"), F.col("size").alias("size2"))
    grid = s1.join(s2, F.col("network1") != F.col("network2"))  # modules, not genes
    full = grid.join(shared, ["network1", "module1", "network2", "module2"], "left").withColumn("inter", F.coalesce("inter", F.lit(0)).cast("long")).crossJoin(F.broadcast(n))  # one row
    return full.select(
        "network1", "module1", "network2", "module2", "size1", "size2", "inter",
        jaccard(F.col("inter"), F.col("size1"), F.col("size2")).alias("jaccard"), (F.col("inter") / F.col("size2")).alias("fraction"),
        hypergeometric_p(F.col("inter"), F.col("size1"), F.col("size2"), F.col("n"), alternative).alias("p"),
    )


def similarity_matrix(compared: DataFrame, value: str = "jaccard") -> DataFrame:
    """Long square matrix (row, column, value) with names network:module: 1 on the diagonal, 0 within a network; p is null there."""
    name = lambda k: F.concat_ws(":", f"network{k}", f"module{k}")
    cells = compared.select(name(1).alias("row"), name(2).alias("column"), F.col(value).alias("value"))
    names = compared.select(name(1).alias("name"), F.col("network1").alias("network")).distinct()
    same = names.alias("x").join(names.alias("y"), "network").select(F.col("x.name").alias("row"), F.col("y.name").alias("column"))
    inside = F.lit(None).cast("double") if value == "p" else F.when(F.col("row") == F.col("column"), 1.0).otherwise(0.0)
    return cells.unionByName(same.select("row", "column", inside.alias("value")))


def similar_modules(compared: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """Edges of the similarity network: pairs, each once, with a Jaccard index of at least the cutoff."""
    name = lambda k: F.concat_ws(":", f"network{k}", f"module{k}")
    return compared.select(name(1).alias("i"), name(2).alias("j"), "jaccard").where((F.col("i") < F.col("j")) & (F.col("jaccard") >= cutoff))


def bubble(compared: DataFrame) -> DataFrame:
    """Plot data: fraction and -log10 p, infinite values shown one above the largest."""
    return compared.select("network1", "module1", "network2", "module2", "fraction", minus_log10(F.col("p"), W.partitionBy(F.lit(1))).alias("log_p"))  # a row a module pair


def enrichment(membership: DataFrame, gene_sets: DataFrame, background: int | None = None) -> DataFrame:
    """Over-representation report by module: term, overlap (x/K), p, p_adjusted (Benjamini-Hochberg within the module), odds_ratio, combined_score, genes.

    Terms without overlap are left out. background is how many genes there are; by default those of the gene sets and modules together."""
    m = membership.select("module", "gene_id").distinct()
    s = gene_sets.select("term", "gene_id").distinct()
    size, terms = m.groupBy("module").agg(F.count(F.lit(1)).alias("n")), s.groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    total = m.select("gene_id").union(s.select("gene_id")).agg(F.countDistinct("gene_id").cast("long").alias("total")) if background is None else m.sparkSession.range(1).select(F.lit(background).cast("long").alias("total"))
    over = m.join(s, "gene_id").groupBy("module", "term").agg(F.count(F.lit(1)).alias("x"), F.array_join(F.sort_array(F.collect_list("gene_id")), ";").alias("genes"))
    full = over.join(size, "module").join(terms, "term").crossJoin(F.broadcast(total))  # one row
    x, k, n, t = F.col("x"), F.col("k"), F.col("n"), F.col("total")
    p = hypergeometric_p(x, n, k, t, "greater")
    below = (n - x) * (k - x)
    odds = x * (t - k - n + x) / F.when(below > 0, below)
    report = full.select("module", "term", F.concat_ws("/", x.cast("string"), k.cast("string")).alias("overlap"), p.alias("p"), odds.alias("odds_ratio"), "genes")
    adjusted = benjamini_hochberg(report, "p", ["module"])
    return adjusted.withColumn("combined_score", -F.log("p") * F.col("odds_ratio"))
