"""Cleaning: expressed genes, good genes, good samples and their fixpoint, outlying samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.plans.runtime import materialize


def expressed_genes(expr: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """gene_id of genes with any value above the cutoff."""
    return expr.groupBy("gene_id").agg(F.max("value").alias("highest")).where(F.col("highest") > cutoff).select("gene_id")


def observed(expr: DataFrame, weights: DataFrame, min_relative_weight: float = 0.1) -> DataFrame:
    """sample_id, gene_id, value, weight, raw: expr with weights(sample_id, gene_id, weight), one row a cell, relative to the gene's largest.

    A value whose relative weight is below the limit becomes null, and so does one without a weight or with a weight that is not finite; ``raw``
    keeps it as it was. A gene whose weights are all 0 keeps them. Weights below 0 are an error."""
    w = F.col("weight")
    checked = F.when(w < 0, F.raise_error(F.lit("weights must not be negative"))).when(~F.isnan(w) & (w < float("inf")), w)
    cells = expr.select("sample_id", "gene_id", F.col("value").alias("raw")).join(weights.select("sample_id", "gene_id", checked.cast("double").alias("weight")), ["sample_id", "gene_id"], "left")
    largest = cells.groupBy("gene_id").agg(F.max("weight").alias("largest"))
    scaled = cells.join(largest, "gene_id").withColumn("weight", w / F.when(F.col("largest") > 0, F.col("largest")).otherwise(1.0))
    seen = ~F.isnan("raw") & (w >= min_relative_weight)
    return scaled.select("sample_id", "gene_id", F.when(seen, F.col("raw")).alias("value"), "weight", "raw")


def good_genes(
    expr: DataFrame, min_fraction: float = 0.5, min_samples: int = 4, min_genes: int = 4, relative_tolerance: float = 1e-10, weights: DataFrame | None = None, min_relative_weight: float = 0.1
) -> DataFrame:
    """gene_id, n_present, n_missing, variance (population), good. A gene is good with enough values and spread. NaN counts as missing.

    With ``weights``(sample_id, gene_id, weight) values of too little relative weight count as missing and the variance is weighted."""
    if weights is not None:
        return _judged_genes(observed(expr, weights, min_relative_weight), min_fraction, min_samples, relative_tolerance)
    return _judged_genes(expr.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), min_fraction, min_samples, relative_tolerance)


def _judged_genes(clean: DataFrame, min_fraction: float, min_samples: int, relative_tolerance: float) -> DataFrame:
    tallest = F.max(F.abs("raw" if "raw" in clean.columns else "value"))
    overall = clean.agg(F.countDistinct("sample_id").alias("n_samples"), (relative_tolerance * tallest).alias("tolerance"))
    if "weight" in clean.columns:
        middle = clean.groupBy("gene_id").agg(F.avg("value").alias("middle"))  # sums about the plain mean lose no digits
        off, w = F.col("value") - F.col("middle"), F.when(F.col("value").isNotNull(), F.col("weight"))
        sums = clean.join(middle, "gene_id").groupBy("gene_id").agg(F.count("value").alias("n_present"), F.sum(w).alias("w"), F.sum(w * off).alias("wx"), F.sum(w * off * off).alias("wxx"))
        whole = F.when(F.col("w") > 0, F.col("w"))
        each = sums.select("gene_id", "n_present", F.greatest(F.col("wxx") / whole - F.pow(F.col("wx") / whole, F.lit(2.0)), F.lit(0.0) * whole).alias("variance"))
    else:
        each = clean.groupBy("gene_id").agg(F.count("value").alias("n_present"), F.var_pop("value").alias("variance"))
    missing = F.col("n_samples") - F.col("n_present")
    good = (F.col("n_present") >= min_samples) & (missing < (1 - min_fraction) * F.col("n_samples")) & (F.coalesce("variance", F.lit(0.0)) > F.pow("tolerance", F.lit(2.0)))
    return each.crossJoin(F.broadcast(overall)).select("gene_id", "n_present", missing.alias("n_missing"), "variance", good.alias("good"))  # one row


def good_samples(expr: DataFrame, min_fraction: float = 0.5, min_genes: int = 4, weights: DataFrame | None = None, min_relative_weight: float = 0.1) -> DataFrame:
    """sample_id, n_present, n_missing, good. With ``weights`` values of too little relative weight count as missing."""
    clean = observed(expr, weights, min_relative_weight) if weights is not None else expr.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    overall = clean.agg(F.countDistinct("gene_id").alias("n_genes"))
    each = clean.groupBy("sample_id").agg(F.count("value").alias("n_present")).crossJoin(F.broadcast(overall))  # one row
    missing = F.col("n_genes") - F.col("n_present")
    return each.select("sample_id", "n_present", missing.alias("n_missing"), ((missing < (1 - min_fraction) * F.col("n_genes")) & (F.col("n_present") >= min_genes)).alias("good"))


def good_samples_genes(expr: DataFrame, min_fraction: float = 0.5, min_samples: int = 4, min_genes: int = 4, weights: DataFrame | None = None, min_relative_weight: float = 0.1) -> DataFrame:
    """expr without bad genes and samples, until none is bad. Each round is written to the shared folder.

    With ``weights`` the columns are sample_id, gene_id and value: weights are scaled once, by all samples, decide what counts as missing, and leave the
    values of what stays as they were."""
    if weights is not None:
        cells = materialize(observed(expr, weights, min_relative_weight), "observed")
        return _settled(cells, min_fraction, min_samples, min_genes).select("sample_id", "gene_id", F.col("raw").alias("value"))
    return _settled(expr, min_fraction, min_samples, min_genes)


def _settled(expr: DataFrame, min_fraction: float, min_samples: int, min_genes: int) -> DataFrame:
    while True:
        clean = expr.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        genes = _judged_genes(clean, min_fraction, min_samples, 1e-10).where("good").select("gene_id")
        kept = expr.join(genes, "gene_id", "left_semi")
        samples = good_samples(kept, min_fraction, min_genes).where("good").select("sample_id")
        kept = materialize(kept.join(samples, "sample_id", "left_semi"), "clean")
        before, after = (df.agg(F.countDistinct("gene_id"), F.countDistinct("sample_id")).first() for df in (expr, kept))
        if after[0] < min_genes or after[1] < min_samples:
            raise ValueError(f"too few genes or samples are left: {after[0]}, {after[1]}")
        if before == after:
            return kept
        expr = kept


def samples_below(expr: DataFrame, cut: float, keep: str = "largest") -> DataFrame:
    """sample_id of samples that stay when average linkage of Euclidean distances is cut at a height; keep the largest or the 'first' sample's cluster."""
    from loomnet.operators.cluster import cut_tree, euclidean, linkage

    items = expr.select(F.col("sample_id").alias("id")).distinct()
    labels = cut_tree(linkage(euclidean(expr, item="sample_id", over="gene_id"), items, "average"), items, cut)
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = size.orderBy(*([F.desc("n"), "first"] if keep == "largest" else ["first"])).limit(1)
    return labels.join(best, "label", "left_semi").select(F.col("id").alias("sample_id"))
