"""The driver's tables as expression data, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as genes, dimensions as samples."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("gene_id"), F.posexplode("embedding").alias("at", "x"))
    return e.select(F.col("at").cast("string").alias("sample_id"), "gene_id", F.col("x").cast("double").alias("value"))


EMB = """expr AS (SELECT (k - 1)::VARCHAR AS sample_id, vec_id::VARCHAR AS gene_id, embedding[k]::DOUBLE AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"""


def emb_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("gene_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("module"))


EMB_MODULES = "genes AS (SELECT vec_id::VARCHAR AS gene_id, 'm' || label::VARCHAR AS module FROM embeddings)"


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions as genes, vectors as samples."""
    return emb(spark, sf_dir).select(F.col("gene_id").alias("sample_id"), F.col("sample_id").alias("gene_id"), "value")


DIM = """expr AS (SELECT vec_id::VARCHAR AS sample_id, (k - 1)::VARCHAR AS gene_id, embedding[k]::DOUBLE AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"""


def supp(spark: SparkSession, sf_dir: str, filled: bool = True) -> DataFrame:
    """Suppliers as genes, ship months as samples, quantities summed; a month without any is 0, or absent if not filled."""
    line = read(spark, sf_dir, "lineitem")
    cells = line.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("sample_id"), F.col("l_suppkey").cast("string").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    if not filled:
        return cells
    grid = cells.select("gene_id").distinct().join(cells.select("sample_id").distinct())
    return grid.join(cells, ["gene_id", "sample_id"], "left").select("sample_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


SUPP_CELLS = "cells AS (SELECT strftime(l_shipdate, '%Y-%m') AS sample_id, l_suppkey::VARCHAR AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
SUPP = SUPP_CELLS + """, expr AS (SELECT s.sample_id, g.gene_id, coalesce(c.value, 0) AS value FROM (SELECT DISTINCT gene_id FROM cells) g
  CROSS JOIN (SELECT DISTINCT sample_id FROM cells) s LEFT JOIN cells c ON c.gene_id = g.gene_id AND c.sample_id = s.sample_id)"""


def supp_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module of a supplier: its region."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").cast("string").alias("gene_id"), F.col("r_name").alias("module"))


SUPP_MODULES = "genes AS (SELECT s_suppkey::VARCHAR AS gene_id, r_name AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample metadata of ship months: year (number), quarter (4 levels), half (2 levels)."""
    m = read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("sample_id")).distinct()
    month = F.substring("sample_id", 6, 2).cast("int")
    return m.select("sample_id", F.substring("sample_id", 1, 4).cast("int").alias("year"), F.concat(F.lit("Q"), F.ceil(month / 3).cast("string")).alias("quarter"), F.when(month <= 6, "H1").otherwise("H2").alias("half"))


MONTHS = """samples AS (SELECT sample_id, left(sample_id, 4)::INT AS year, 'Q' || ((substr(sample_id, 6, 2)::INT + 2) // 3)::VARCHAR AS quarter,
  CASE WHEN substr(sample_id, 6, 2)::INT <= 6 THEN 'H1' ELSE 'H2' END AS half FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS sample_id FROM lineitem))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as genes, days as samples; absent cells stay absent."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("sample_id"), F.col("user_id").cast("string").alias("gene_id")).agg(F.sum("value").alias("value"))


EVENTS = "expr AS (SELECT strftime(ts, '%Y-%m-%d') AS sample_id, user_id::VARCHAR AS gene_id, sum(value) AS value FROM events GROUP BY ALL)"


def customer_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """membership of customers: market segments (A), regions (B) and, as a marker list, the priority of their last order."""
    c, n, r, o = (read(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    key = F.col("c_custkey").cast("string").alias("gene_id")
    a = c.select(F.lit("A").alias("network"), F.col("c_mktsegment").alias("module"), key)
    b = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lit("B").alias("network"), F.col("r_name").alias("module"), key)
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("module"))
    s = last.select(F.lit("single_cell").alias("network"), "module", F.col("o_custkey").cast("string").alias("gene_id"))
    return a.unionByName(b).unionByName(s)


CUSTOMER_NETWORKS = """membership AS (
  SELECT 'A' AS network, c_mktsegment AS module, c_custkey::VARCHAR AS gene_id FROM customer
  UNION ALL SELECT 'B', r_name, c_custkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'single_cell', o_orderpriority, o_custkey::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1)"""
