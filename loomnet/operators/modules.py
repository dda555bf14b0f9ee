"""Modules: names, eigengenes, dissimilarities, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.functions.stats import pearson
from loomnet.operators.cluster import cut_tree, leaf_order, linkage
from loomnet.operators.network import dense, packed, places, zscores
from loomnet.plans.runtime import materialize


def color_table(spark, colors: list[str], grey: str = "grey") -> DataFrame:
    """(number, color): 0 is grey; numbers past the list start over with a suffix."""
    return spark.createDataFrame([(0, grey)] + [(k + 1, c) for k, c in enumerate(colors)], "number int, color string")


def labels_to_colors(numbered: DataFrame, colors: list[str], grey: str = "grey") -> DataFrame:
    """Adds color to rows with a number; null and 0 are grey. Colours repeat as name.1, name.2 when they run out."""
    n = len(colors)
    listed = F.array(*[F.lit(c) for c in colors])
    k = F.col("number") - 1
    turn = F.floor(k / n).cast("int")
    name = F.element_at(listed, (k % n + 1).cast("int"))
    return numbered.withColumn("color", F.when(F.coalesce("number", F.lit(0)) <= 0, F.lit(grey)).when(turn == 0, name).otherwise(F.concat(name, F.lit("."), turn)))


def module_labels(membership: DataFrame) -> DataFrame:
    """Adds module_label: the place of the module in the sorted list of modules, from 0."""
    names = membership.select("module").distinct().withColumn("module_label", F.dense_rank().over(W.orderBy("module")) - 1)  # a row a module
    return membership.join(names, "module")


def average_expression(expr: DataFrame, membership: DataFrame) -> DataFrame:
    """(sample_id, module, value): mean of the module's standardised genes."""
    return zscores(expr).join(membership.select("gene_id", "module"), "gene_id").groupBy("sample_id", "module").agg(F.avg("value").alias("value"))


def eigengenes(expr: DataFrame, membership: DataFrame) -> DataFrame:
    """(sample_id, module, value): the first principal component over samples of each module's standardised genes, of unit norm and
    positively correlated with the module's average expression; where that is uncorrelated, the first sample's value is positive.

    Tasks multiply the genes they have into samples x samples products by module; only these are brought together, so a module may have any number of
    genes. Missing values count as the gene's mean."""
    z = zscores(expr).join(membership.select("gene_id", "module"), "gene_id")
    samples = places(expr, "sample_id")
    rows, p = packed(z.withColumn("row", F.struct("module", "gene_id")), "row", "sample_id", place=samples)
    rows = rows.select(F.col("id.module").alias("module"), "at", "v")
    def products(batches):
        for batch in batches:
            x = dense(batch, p)
            module = np.array(batch.column("module").to_pylist(), object)
            names = sorted(set(module))
            grams = [x[module == m] for m in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([(g.T @ g).tobytes() for g in grams], pa.binary()), pa.array([g.sum(0).tobytes() for g in grams], pa.binary())], names=["module", "gram", "total"])

    def first(key, table):
        gram = sum(np.frombuffer(b, np.float64) for b in table["gram"].to_pylist()).reshape(p, p)
        total = sum(np.frombuffer(b, np.float64) for b in table["total"].to_pylist())
        vector = np.linalg.eigh(gram)[1][:, -1]
        turn = vector @ total
        if abs(turn) <= 1e-9 * np.linalg.norm(total):  # neither, as in two genes that run against each other
            turn = vector[0]
        if turn < 0:
            vector = -vector
        return pa.table({"module": pa.array([key[0].as_py()] * p), "at": pa.array(range(p), pa.int32()), "value": vector})

    me = rows.mapInArrow(products, "module string, gram binary, total binary").groupBy("module").applyInArrow(first, "module string, at int, value double")
    return me.join(samples.withColumnRenamed("__at", "at"), "at").select("sample_id", "module", "value")


def multiset_eigengenes(expr: DataFrame, membership: DataFrame) -> DataFrame:
    """(set_id, sample_id, module, value): eigengenes of the same modules in each set of samples (expr with set_id), every set standardised by itself."""
    sets = check_sets(expr)
    parts = [eigengenes(expr.where(F.col("set_id") == s).drop("set_id"), membership).withColumn("set_id", F.lit(s)) for s in sets]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("set_id", "sample_id", "module", "value")


def check_sets(expr: DataFrame) -> list:
    """The set ids of multi-set data; ValueError where sets do not have the same genes."""
    counts = expr.groupBy("set_id").agg(F.countDistinct("gene_id").alias("n")).collect()  # a row a set
    genes = expr.agg(F.countDistinct("gene_id")).first()[0]
    if any(r["n"] != genes for r in counts):
        raise ValueError("the sets have different genes")
    return sorted(r["set_id"] for r in counts)


def module_heatmap(expr: DataFrame, membership: DataFrame, me: DataFrame, module: str) -> DataFrame:
    """(sample_id, gene_id, value, eigengene): one module's genes scaled to 0..1 with its eigengene beside them."""
    from loomnet.operators.network import min_max

    own = min_max(expr.join(membership.where(F.col("module") == module).select("gene_id"), "gene_id", "left_semi"))
    return own.join(me.where(F.col("module") == module).select("sample_id", F.col("value").alias("eigengene")), "sample_id").select("sample_id", "gene_id", "value", "eigengene")


def average_rank(df: DataFrame, value: str, by: list[str], into: str = "rank") -> DataFrame:
    """Adds the rank of a value within its group; equal values share the mean of their ranks."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(value))
    return df.withColumn(into, nth).withColumn(into, F.avg(into).over(W.partitionBy(*by, value)))


def signed_kme(expr: DataFrame, me: DataFrame) -> DataFrame:
    """(gene_id, module, r): correlation of every gene with every eigengene; a join on the samples and one aggregation."""
    z = zscores(expr)
    m = me.select("sample_id", "module", F.col("value").alias("y"))
    return z.join(m, "sample_id").groupBy("gene_id", "module").agg(pearson(F.col("value"), F.col("y")).alias("r"))


def variance_explained(kme: DataFrame, membership: DataFrame) -> DataFrame:
    """(module, explained): mean squared correlation of the module's genes with its eigengene."""
    return kme.join(membership.select("gene_id", "module"), ["gene_id", "module"]).groupBy("module").agg(F.avg(F.col("r") * F.col("r")).alias("explained"))


def me_dissimilarity(me: DataFrame, absolute: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., i, j, d), i < j: one minus the (absolute) correlation of eigengenes; keys such as set_id keep sets apart."""
    a = me.select(*keys, "sample_id", F.col("module").alias("i"), F.col("value").alias("x"))
    b = me.select(*keys, "sample_id", F.col("module").alias("j"), F.col("value").alias("y"))
    r = pearson(F.col("x"), F.col("y"))
    return a.join(b, [*keys, "sample_id"]).where("i < j").groupBy(*keys, "i", "j").agg((1 - (F.abs(r) if absolute else r)).alias("d"))


def consensus(diss: DataFrame, how: str = "consensus", quantile: float = 0.0) -> DataFrame:
    """(i, j, d) over sets: 'consensus' the largest, 'majority' the mean, 'quantile' the 1 - quantile point."""
    value = {"consensus": F.max("d"), "majority": F.avg("d"), "quantile": F.percentile("d", F.lit(1.0 - quantile))}[how]
    return diss.groupBy("i", "j").agg(value.alias("d"))


def equalize_quantiles(diss: DataFrame, summary: str = "mean") -> DataFrame:
    """(set_id, i, j, d) with each set's values replaced by the mean or median over sets of the values of the same rank; ties take the mean of their ranks' values."""
    over_sets = {"mean": F.avg("d"), "median": F.median("d")}[summary]
    by = W.partitionBy("set_id").orderBy("d", "i", "j")
    ranked = diss.withColumn("rank", F.row_number().over(by))
    mean = ranked.groupBy("rank").agg(over_sets.alias("m"))
    tied = ranked.join(mean, "rank")
    return tied.select("set_id", "i", "j", F.avg("m").over(W.partitionBy("set_id", "d")).alias("d"))


def merge_close_modules(expr: DataFrame, membership: DataFrame, cut: float = 0.2, grey: str = "grey", linkage_method: str = "average") -> DataFrame:
    """membership with modules merged whose eigengenes lie below the cut, again and again until none does; a merged branch takes its first module's name."""
    current = materialize(membership.select("gene_id", "module"), "membership")
    while True:
        proper = current.where(F.col("module") != grey)
        before = proper.select("module").distinct().count()
        if before < 2:
            return current
        diss = me_dissimilarity(eigengenes(expr, proper))
        names = proper.select(F.col("module").alias("id")).distinct()
        labels = cut_tree(linkage(diss, names, linkage_method), names, cut)
        current = materialize(current.join(labels.select(F.col("id").alias("module"), "label"), "module", "left").select("gene_id", F.coalesce("label", "module").alias("module")), "membership")
        if current.where(F.col("module") != grey).select("module").distinct().count() == before:
            return current


def merge_on_consensus(
    expr: DataFrame, membership: DataFrame, cut: float = 0.2, quantile: float = 0.0, absolute: bool = False, equalize: str | None = None, grey: str = "grey", linkage_method: str = "average", rounds: int | None = None,
) -> DataFrame:
    """(gene_id, module, number): modules merged that lie below the cut in all of several sets of samples (expr with set_id), again and again until none does, or
    for ``rounds`` rounds. A merged branch takes its first module's name; numbers go by falling size, then name, and grey is 0.

    Every round the dissimilarity of two modules' eigengenes is worked out in each set and the 1 - ``quantile`` point over sets counts (0: the largest). ``absolute`` takes
    eigengenes that run against each other for near, ``equalize`` ('mean' or 'median') first gives all sets the same distribution of values. Modules without an eigengene in some set stay apart."""
    current = materialize(membership.select("gene_id", "module").distinct(), "membership")
    done = 0
    while rounds is None or done < rounds:
        proper = current.where(F.col("module") != grey)
        before = proper.select("module").distinct().count()
        if before < 2:
            break
        diss = me_dissimilarity(multiset_eigengenes(expr, proper), absolute, ("set_id",))
        if equalize:
            diss = equalize_quantiles(diss, equalize)
        joint = materialize(consensus(diss, "quantile", quantile), "consensus")
        names = proper.select(F.col("module").alias("id")).distinct()
        labels = cut_tree(materialize(linkage(joint, names, linkage_method), "tree"), names, cut)
        current = materialize(current.join(labels.select(F.col("id").alias("module"), "label"), "module", "left").select("gene_id", F.coalesce("label", "module").alias("module")), "membership")
        done += 1
        if current.where(F.col("module") != grey).select("module").distinct().count() == before:
            break
    size = current.where(F.col("module") != grey).groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    number = size.select("module", F.row_number().over(W.orderBy(F.desc("n"), "module")).alias("number"))  # a row a module
    return current.join(number, "module", "left").select("gene_id", "module", F.coalesce("number", F.lit(0)).alias("number"))


def order_by_tree(diss: DataFrame, names: DataFrame, grey: str = "grey") -> DataFrame:
    """(module, ord): modules (id) in the leaf order of the average-linkage tree of their dissimilarities (i, j, d), with grey last."""
    names = materialize(names.select("id").distinct(), "names")
    proper = diss.where((F.col("i") != grey) & (F.col("j") != grey))
    tree = materialize(linkage(proper, names.where(F.col("id") != grey), "average"), "tree")
    placed = leaf_order(tree, names.where(F.col("id") != grey))
    last = names.where(F.col("id") == grey).select("id", F.lit(None).cast("long").alias("ord"))
    nth = F.row_number().over(W.orderBy(F.col("ord").asc_nulls_last())) - 1  # a row a module
    return placed.unionByName(last).select(F.col("id").alias("module"), nth.cast("int").alias("ord"))


def order_modules(me: DataFrame, grey: str = "grey") -> DataFrame:
    """(module, ord): modules along the tree of their eigengenes, with grey last."""
    return order_by_tree(me_dissimilarity(me), me.select(F.col("module").alias("id")), grey)


def order_modules_by_set(me: DataFrame, by=None, grey: str = "grey") -> DataFrame:
    """The order of one set (``by``, else the first) of multi-set eigengenes (with set_id), for all sets."""
    by = me.agg(F.min("set_id")).first()[0] if by is None else by
    return order_modules(me.where(F.col("set_id") == by).drop("set_id"), grey)


def consensus_order(me: DataFrame, how: str = "consensus", absolute: bool = False, grey: str = "grey") -> DataFrame:
    """(module, ord) by the consensus ('consensus' or 'majority') of the sets' dissimilarities of eigengenes."""
    return order_by_tree(consensus(me_dissimilarity(me, absolute, ("set_id",)), how), me.select(F.col("module").alias("id")), grey)
