"""Traits: encoding of sample metadata and correlation with module eigengenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.functions.stats import pearson, student_p


def encode_traits(samples: DataFrame, columns: list[str] | None = None, id_column: str = "sample_id") -> DataFrame:
    """(sample_id, trait, value): numbers as they are; two levels as 0 and 1 in sorted order; more levels one 0/1 trait each, named after the level (with the
    column before it where two columns share the level); one level is dropped. Null stays null."""
    columns = columns or [c for c in samples.columns if c != id_column]
    kinds = dict(samples.dtypes)
    parts = []
    text = [c for c in columns if kinds[c] in ("string", "boolean", "date")]
    levels = {}
    for c in text:
        levels[c] = sorted(str(r[0]) for r in samples.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().collect())  # levels of a trait
    shared = [v for c in text for v in levels[c] if len(levels[c]) > 2]
    for c in columns:
        value = F.col(c).cast("string")
        if c not in text:
            parts.append((c, F.col(c).cast("double")))
        elif len(levels[c]) == 2:
            parts.append((c, F.when(value.isNotNull(), (value == levels[c][1]).cast("double"))))
        elif len(levels[c]) > 2:
            parts += [(v if shared.count(v) == 1 and v not in columns else f"{c}_{v}", F.when(value.isNotNull(), (value == v).cast("double"))) for v in levels[c]]
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("trait"), e.alias("value")) for name, e in parts]))
    return samples.select(F.col(id_column).alias("sample_id"), cells.alias("c")).select("sample_id", "c.trait", "c.value")


def module_trait(me: DataFrame, traits: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """(module, trait, r, n, p)."""
    t = traits.select("sample_id", "trait", F.col("value").alias("y"))
    pairs = me.join(t, "sample_id").groupBy("module", "trait").agg(pearson(F.col("value"), F.col("y")).alias("r"), F.count(F.when(F.col("value").isNotNull(), F.col("y"))).alias("n"))
    return pairs.select("module", "trait", "r", "n", student_p(F.col("r"), F.col("n"), alternative).alias("p"))


def heatmap_labels(pairs: DataFrame) -> DataFrame:
    """Adds the text of a heatmap cell: r to two places and, below, p to three in brackets."""
    return pairs.withColumn("label", F.format_string("%.2f\n(%.3f)", "r", "p"))


def eigengene_by_trait(me: DataFrame, samples: DataFrame, columns: list[str], id_column: str = "sample_id") -> DataFrame:
    """(module, key, mean, sd, n): an eigengene's mean and sample deviation over samples with the same metadata."""
    key = samples.select(F.col(id_column).alias("sample_id"), F.concat_ws("_", *[F.col(c).cast("string") for c in columns]).alias("key"))
    return me.join(key, "sample_id").groupBy("module", "key").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
