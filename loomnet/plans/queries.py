"""The engine's registered queries and the SQL that says the same. Values are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnet.functions import stats
from loomnet.model import Config
from loomnet.operators import clean, cluster, compare, components, lookup, modules, network, traits
from loomnet.plans import fixtures as fx
from loomnet.plans.colors import COLORS
from loomnet.plans.runtime import shared_path
from loomnet.sources import tables

POWERS = Config().powers
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with SQL if there is some."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- fragments of SQL -----------------------------------------------------------
R = """pairs AS (SELECT a.gene_id AS i, b.gene_id AS j, CASE WHEN var_pop(a.value) > 0 AND var_pop(b.value) > 0 THEN corr(a.value, b.value) END AS r
  FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY ALL)"""
ADJ = "adj AS (SELECT i, j, pow({s}, {p}) AS a FROM pairs)"
HYBRID, SIGNED, UNSIGNED = "greatest(r, 0)", "(1 + r) / 2", "abs(r)"
BOTH = "both_ AS (SELECT i AS g, j AS o, a FROM adj UNION ALL SELECT j, i, a FROM adj), k AS (SELECT g, sum(a) AS k FROM both_ GROUP BY g)"
NAMED_POWERS = ", ".join(f"({p})" for p in POWERS)
SCAN = f"""WITH {fx.SUPP}, {R}, s AS (SELECT i, j, {HYBRID} AS s FROM pairs), m AS (SELECT i AS g, s FROM s UNION ALL SELECT j, s FROM s),
kk AS (SELECT power, g, sum(pow(s, power)) AS k FROM m, (VALUES {NAMED_POWERS}) p(power) GROUP BY ALL)"""
FIT = """, span AS (SELECT power, min(k) AS low, max(k) AS high, count(*) AS n FROM kk GROUP BY power),
binned AS (SELECT power, coalesce(greatest(1, least(10, ceil((k - low) / CASE WHEN high > low THEN (high - low) / 10 END))), 1)::INT AS bin, avg(k) AS mean, count(*) AS c FROM kk JOIN span USING (power) GROUP BY ALL),
points AS (SELECT power, coalesce(mean, low + (bin - 0.5) * (high - low) / 10) AS dk, coalesce(c, 0) / n AS p FROM (SELECT *, unnest(range(1, 11))::INT AS bin FROM span) LEFT JOIN binned USING (power, bin)),
logs AS (SELECT power, dk, CASE WHEN dk > 0 THEN log10(dk) END AS x, log10(p + 1e-9) AS y FROM points),
fit AS (SELECT power, corr(y, x) AS r1, corr(y, dk) AS r2, corr(x, dk) AS r12, regr_slope(y, x) AS slope, count(x) AS m FROM logs GROUP BY power),
sft AS (SELECT power, r1 * r1 AS r_sq, slope, 1 - (1 - (r1*r1 + r2*r2 - 2*r1*r2*r12) / (1 - r12*r12)) * (m - 1) / (m - 3) AS truncated_r_sq FROM fit)"""


def lchoose(a: str, b: str) -> str:
    return f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - ({b}) + 1))"


OVERLAPS = """, m AS (SELECT DISTINCT * FROM membership), sizes AS (SELECT network, module, count(*) AS size FROM m GROUP BY ALL), total AS (SELECT count(DISTINCT gene_id) AS n FROM m),
shared AS (SELECT a.network AS network1, a.module AS module1, b.network AS network2, b.module AS module2, count(*) AS inter FROM m a JOIN m b ON a.gene_id = b.gene_id AND a.network <> b.network GROUP BY ALL),
full_ AS (SELECT s1.network AS network1, s1.module AS module1, s2.network AS network2, s2.module AS module2, s1.size AS size1, s2.size AS size2, coalesce(inter, 0) AS inter, n
  FROM sizes s1 JOIN sizes s2 ON s1.network <> s2.network CROSS JOIN total LEFT JOIN shared h ON h.network1 = s1.network AND h.module1 = s1.module AND h.network2 = s2.network AND h.module2 = s2.module)"""


# --- trees as SQL ------------------------------------------------------------------------------
#: Average linkage of pairs d(i, j, d) by rounds, each merging all pairs that are nearest to each other; needs WITH RECURSIVE.
LINK = """tree AS (
  SELECT 0 AS step, i, j, d, 1::BIGINT AS si, 1::BIGINT AS sj, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::VARCHAR AS node, NULL::DOUBLE AS height, NULL::BIGINT AS size FROM d
  UNION ALL (
  WITH open_ AS (SELECT * FROM tree WHERE node IS NULL),
  ends AS (SELECT step, i, j, d, si, sj, i AS a FROM open_ UNION ALL SELECT step, i, j, d, si, sj, j FROM open_),
  least_ AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, i, j) = 1),
  met AS (SELECT step + 1 AS step, i AS l, j AS r, i || '~' || (step + 1)::VARCHAR AS node, d AS height, si, sj, si + sj AS size FROM least_ GROUP BY step, i, j, d, si, sj HAVING count(*) = 2),
  moved AS (SELECT l AS old, node, size, si / size AS share FROM met UNION ALL SELECT r, node, size, sj / size FROM met),
  again AS (SELECT step + 1 AS step, coalesce(a.node, i) AS p, coalesce(b.node, j) AS q, coalesce(a.size, si) AS sp, coalesce(b.size, sj) AS sq, d, coalesce(a.share, 1) * coalesce(b.share, 1) AS w
    FROM open_ LEFT JOIN moved a ON a.old = i LEFT JOIN moved b ON b.old = j)
  SELECT step, least(p, q), greatest(p, q), sum(d * w), any_value(CASE WHEN p < q THEN sp ELSE sq END), any_value(CASE WHEN p < q THEN sq ELSE sp END), NULL, NULL, NULL, NULL, NULL FROM again WHERE p <> q GROUP BY step, least(p, q), greatest(p, q)
  UNION ALL SELECT step, NULL, NULL, NULL, NULL, NULL, l, r, node, height, size FROM met)),
dendro AS (SELECT l AS "left", r AS "right", node, height, size, step AS round FROM tree WHERE node IS NOT NULL)"""
#: Places of leaves from the left, of one tree over all items.
LEAVES = """walk(id, spot) AS (SELECT node, 0::BIGINT FROM dendro WHERE node NOT IN (SELECT "left" FROM dendro UNION ALL SELECT "right" FROM dendro)
  UNION ALL SELECT c.id, c.spot FROM (SELECT unnest([{'id': o."left", 'spot': w.spot}, {'id': o."right", 'spot': w.spot + coalesce(l.size, 1)}]) AS c FROM walk w JOIN dendro o ON o.node = w.id LEFT JOIN dendro l ON l.node = o."left")),
leaf AS (SELECT id, spot AS ord FROM walk WHERE id NOT IN (SELECT node FROM dendro))"""
MONTHS_APART = f"WITH RECURSIVE {fx.SUPP}, d AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM expr a JOIN expr b ON a.gene_id = b.gene_id AND a.sample_id < b.sample_id GROUP BY ALL), {LINK}"


def _flat(height: str, items: str) -> str:
    """flat(id, label): clusters below a height."""
    return f"""up AS (SELECT c.id, node AS parent, height FROM (SELECT unnest([{{'id': "left"}}, {{'id': "right"}}]) AS c, node, height FROM dendro)), cut AS (SELECT {height} AS h),
below(id, top) AS (SELECT node, node FROM dendro LEFT JOIN up ON up.id = node, cut WHERE dendro.height <= h AND coalesce(up.height > h, true) UNION ALL SELECT up.id, below.top FROM below JOIN up ON up.parent = below.id),
flat AS (SELECT id, min(id) OVER (PARTITION BY coalesce(top, id)) AS label FROM ({items}) LEFT JOIN below USING (id))"""


# --- cleaning --------------------------------------------------------------------------------
@query(f"WITH {fx.EMB} SELECT gene_id FROM expr GROUP BY gene_id HAVING max(value) > 0.25")
def p1_expressed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.expressed_genes(fx.emb(spark, sf_dir), 0.25)


@query(f"""WITH {fx.EVENTS}, o AS (SELECT count(DISTINCT sample_id) AS s, 1e-10 * max(abs(value)) AS tol FROM expr)
SELECT gene_id, count(value) AS n_present, s - count(value) AS n_missing, round(var_pop(value), 6) AS variance,
 count(value) >= 4 AND s - count(value) < 0.5 * s AND coalesce(var_pop(value), 0) > tol * tol AS good FROM expr, o GROUP BY gene_id, s, tol""")
def p2_good_genes(spark, sf_dir):
    return rounded(clean.good_genes(fx.events(spark, sf_dir)), "variance")


@query(f"""WITH {fx.EVENTS}, o AS (SELECT count(DISTINCT gene_id) AS g FROM expr)
SELECT sample_id, count(value) AS n_present, g - count(value) AS n_missing, g - count(value) < 0.5 * g AND count(value) >= 4 AS good FROM expr, o GROUP BY sample_id, g""")
def p3_good_samples(spark, sf_dir):
    return clean.good_samples(fx.events(spark, sf_dir))


def _clean_round(k: int) -> str:
    """One round of dropping bad genes, then bad samples, as SQL over e<k>."""
    return f"""g{k} AS (SELECT gene_id FROM e{k}, (SELECT count(DISTINCT sample_id) AS s, 1e-10 * max(abs(value)) AS tol FROM e{k}) GROUP BY gene_id, s, tol
 HAVING count(value) >= 4 AND s - count(value) < 0.5 * s AND coalesce(var_pop(value), 0) > tol * tol), h{k} AS (SELECT * FROM e{k} WHERE gene_id IN (FROM g{k})),
s{k} AS (SELECT sample_id FROM h{k}, (SELECT count(DISTINCT gene_id) AS g FROM h{k}) GROUP BY sample_id, g HAVING g - count(value) < 0.5 * g AND count(value) >= 4), e{k + 1} AS (SELECT * FROM h{k} WHERE sample_id IN (FROM s{k}))"""


@query(f"WITH {fx.SUPP_CELLS}, e0 AS (FROM cells), " + ", ".join(map(_clean_round, range(6))) + " SELECT gene_id, count(value) AS n_samples FROM e6 GROUP BY gene_id")
def p4_good_samples_genes(spark, sf_dir):
    """The SQL spells out six rounds, more than these tables need until nothing changes."""
    return clean.good_samples_genes(fx.supp(spark, sf_dir, filled=False)).groupBy("gene_id").agg(F.count("value").alias("n_samples"))


#: Days of users, weighed by how many events they have, relative to the user's busiest day; what is under half of that is as good as missing.
SEEN = """seen AS (SELECT e.*, w.n / max(w.n) OVER (PARTITION BY gene_id) AS w, CASE WHEN w.n >= 0.5 * max(w.n) OVER (PARTITION BY gene_id) THEN value END AS v
  FROM expr e JOIN (SELECT strftime(ts, '%Y-%m-%d') AS sample_id, user_id::VARCHAR AS gene_id, count(*) AS n FROM events GROUP BY ALL) w USING (sample_id, gene_id))"""


def _event_weights(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("sample_id"), F.col("user_id").cast("string").alias("gene_id")).agg(F.count(F.lit(1)).alias("weight"))


@query(f"""WITH {fx.EVENTS}, {SEEN}, o AS (SELECT count(DISTINCT sample_id) AS s, 1e-10 * max(abs(value)) AS tol FROM expr),
m AS (SELECT gene_id, count(v) AS n, sum(w * v) / sum(w) AS mean FROM seen WHERE v IS NOT NULL GROUP BY gene_id), q AS (SELECT gene_id, sum(w * pow(v - mean, 2)) / sum(w) AS variance FROM seen JOIN m USING (gene_id) WHERE v IS NOT NULL GROUP BY gene_id)
SELECT gene_id, n AS n_present, s - n AS n_missing, round(variance, 6) AS variance, n >= 4 AND s - n < 0.7 * s AND variance > tol * tol AS good FROM m JOIN q USING (gene_id), o""")
def p2_weighted_good_genes(spark, sf_dir):
    return rounded(clean.good_genes(fx.events(spark, sf_dir), min_fraction=0.3, weights=_event_weights(spark, sf_dir), min_relative_weight=0.5), "variance")


@query(f"""WITH {fx.EVENTS}, {SEEN}, o AS (SELECT count(DISTINCT gene_id) AS g FROM expr)
SELECT sample_id, count(v) AS n_present, g - count(v) AS n_missing, g - count(v) < 0.7 * g AND count(v) >= 4 AS good FROM seen, o GROUP BY sample_id, g""")
def p3_weighted_good_samples(spark, sf_dir):
    return clean.good_samples(fx.events(spark, sf_dir), min_fraction=0.3, weights=_event_weights(spark, sf_dir), min_relative_weight=0.5)


def _weighted_round(k: int) -> str:
    """One round over u<k> of dropping bad genes, then bad samples, with weights."""
    return f"""m{k} AS (SELECT gene_id, count(v) AS n, sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL) AS mean FROM u{k} GROUP BY gene_id),
g{k} AS (SELECT gene_id FROM u{k} JOIN m{k} USING (gene_id), (SELECT count(DISTINCT sample_id) AS s, 1e-10 * max(abs(value)) AS tol FROM u{k}) GROUP BY gene_id, n, s, tol
 HAVING n >= 4 AND s - n < 0.7 * s AND coalesce(sum(w * pow(v - mean, 2)) / sum(w) FILTER (WHERE v IS NOT NULL), 0) > tol * tol), h{k} AS (SELECT * FROM u{k} WHERE gene_id IN (FROM g{k})),
s{k} AS (SELECT sample_id FROM h{k}, (SELECT count(DISTINCT gene_id) AS g FROM h{k}) GROUP BY sample_id, g HAVING g - count(v) < 0.7 * g AND count(v) >= 4), u{k + 1} AS (SELECT * FROM h{k} WHERE sample_id IN (FROM s{k}))"""


@query(f"WITH {fx.EVENTS}, {SEEN}, u0 AS (FROM seen), " + ", ".join(map(_weighted_round, range(5))) + " SELECT sample_id, gene_id, round(value, 6) AS value FROM u5")
def p4_weighted_good_samples_genes(spark, sf_dir):
    """The SQL spells out five rounds, more than these tables need until nothing changes."""
    return rounded(clean.good_samples_genes(fx.events(spark, sf_dir), min_fraction=0.3, weights=_event_weights(spark, sf_dir), min_relative_weight=0.5), "value")


@query(f"""{MONTHS_APART}, {_flat("1500.0", "SELECT DISTINCT sample_id AS id FROM expr")}
SELECT id AS sample_id FROM flat WHERE label = (SELECT label FROM flat GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)""")
def p5_outlying_samples(spark, sf_dir):
    return clean.samples_below(fx.supp(spark, sf_dir), cut=1500.0)


@query(f"WITH {fx.SUPP_MODULES} SELECT gene_id, module FROM genes WHERE module IN ('ASIA', 'EUROPE')")
def p6_genes_of_modules(spark, sf_dir):
    return lookup.genes_of_modules(fx.supp_modules(spark, sf_dir), ["ASIA", "EUROPE"]).select("gene_id", "module")


@query(f"WITH {fx.SUPP_MODULES} SELECT gene_id, module FROM genes WHERE gene_id IN (SELECT l_suppkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')")
def p7_gene_module(spark, sf_dir):
    returned = fx.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("gene_id"))
    return lookup.modules_of_genes(fx.supp_modules(spark, sf_dir), returned)


@query(f"WITH {fx.SUPP_MODULES} SELECT DISTINCT module FROM genes")
def p8_module_names(spark, sf_dir):
    return lookup.module_names(fx.supp_modules(spark, sf_dir))


@query("SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_regionkey IN (1, 2)")
def p9_attribute_filter(spark, sf_dir):
    c = fx.read(spark, sf_dir, "customer").join(fx.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lookup.filter_attributes(c, {"c_mktsegment": ["BUILDING", "MACHINERY"], "n_regionkey": [1, 2]}).select("c_custkey", "c_mktsegment")


# --- sources ------------------------------------------------------------------------------------
@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, n_name AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def s4_gene_upsert(spark, sf_dir):
    c = fx.read(spark, sf_dir, "customer")
    new = c.join(fx.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("c_mktsegment"))
    return tables.upsert(c, new, "c_custkey")


@query(f"WITH {fx.MONTHS} SELECT sample_id, year, half, lower(quarter) AS quarter FROM samples")
def s5_sample_upsert(spark, sf_dir):
    m = fx.months(spark, sf_dir)
    return tables.upsert(m, m.select("sample_id", F.lower("quarter").alias("quarter")), "sample_id").select("sample_id", "year", "half", "quarter")


@query(f"WITH {fx.SUPP} SELECT sample_id, gene_id, value FROM expr")
def s2_wide_to_long(spark, sf_dir):
    """A wide table, a supplier a column (or, of very many, an entry of a map), read back into long form."""
    return tables.wide_to_long(tables.long_to_wide(fx.supp(spark, sf_dir)))


@query("""SELECT gene1, gene2, score FROM (SELECT l_suppkey::VARCHAR AS gene1, l_partkey::VARCHAR AS gene2, sum(l_quantity) AS score,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey::VARCHAR) AS nth FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE nth <= 5""")
def s10_partners(spark, sf_dir):
    edges = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("gene1"), F.col("l_partkey").cast("string").alias("gene2")).agg(F.sum("l_quantity").alias("score"))
    return lookup.partners(edges, fx.supp_modules(spark, sf_dir))


# --- networks -------------------------------------------------------------------------------------
@query(f"WITH {fx.EMB}, {R} SELECT i, j, round(r, 6) + 0.0 AS r FROM pairs")
def n1_correlation(spark, sf_dir):
    return rounded(network.correlation(fx.emb(spark, sf_dir)), "r")


@query(f"WITH {fx.SUPP}, {R} SELECT i, j, round(r, 6) + 0.0 AS r FROM pairs")
def n1_correlation_block(spark, sf_dir):
    return rounded(network.correlation(fx.supp(spark, sf_dir), plan="block"), "r")


def _adjacency(kind: str, s: str):
    @query(f"WITH {fx.SUPP}, {R}, {ADJ.format(s=s, p=6)} SELECT i, j, round(a, 6) + 0.0 AS a FROM adj")
    def f(spark, sf_dir):
        return rounded(network.adjacency(network.correlation(fx.supp(spark, sf_dir)), kind, 6), "a")

    name = f"n2_adjacency_{kind.split()[-1]}"
    f.__name__ = name
    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


for _kind, _s in (("unsigned", UNSIGNED), ("signed", SIGNED), ("signed hybrid", HYBRID)):
    _adjacency(_kind, _s)


def _powers(spark, sf_dir):
    return network.connectivity_by_power(fx.supp(spark, sf_dir), POWERS)


@query(SCAN + FIT + """SELECT power, round(r_sq, 5) AS r_sq, round(slope, 5) AS slope, round(avg(k), 6) AS mean_k, round(median(k), 6) AS median_k, round(max(k), 6) AS max_k
FROM kk JOIN sft USING (power) GROUP BY power, r_sq, slope""")
def n3_soft_threshold(spark, sf_dir):
    t = network.soft_threshold_table(_powers(spark, sf_dir)).drop("truncated_r_sq")
    return rounded(t, "mean_k", "median_k", "max_k").withColumns({c: F.round(c, 5) for c in ("r_sq", "slope")})


@query(SCAN + FIT + "SELECT power, round(r_sq, 4) AS r_sq, round(slope, 4) AS slope, round(truncated_r_sq, 4) AS truncated_r_sq FROM sft")
def n4_scale_free_fit(spark, sf_dir):
    return network.scale_free_fit(_powers(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("r_sq", "slope", "truncated_r_sq")})


@query(SCAN + """SELECT power, round(sum(k) / (count(*) * (count(*) - 1)), 6) AS density, round(count(*) * (max(k) - avg(k)) / ((count(*) - 1) * (count(*) - 2)), 6) AS centralization,
round(sqrt(greatest(0, count(*) * sum(k * k) / (sum(k) * sum(k)) - 1)), 6) AS heterogeneity FROM kk GROUP BY power""")
def n5_network_concepts(spark, sf_dir):
    return rounded(network.network_concepts(_powers(spark, sf_dir)), "density", "centralization", "heterogeneity")


@query(SCAN + FIT + ", t AS (SELECT power, r_sq, mean_k FROM sft JOIN (SELECT power, avg(k) AS mean_k FROM kk GROUP BY power) USING (power)) SELECT coalesce(min(power) FILTER (r_sq > 0.9 AND mean_k <= 100), arg_max(power, r_sq))::INT AS power FROM t")
def n3_picked_power(spark, sf_dir):
    return network.pick_power(network.soft_threshold_table(_powers(spark, sf_dir)))


TOM_SQL = f"""WITH {fx.DIM}, {R}, {ADJ.format(s=HYBRID, p=2)}, {BOTH},
l AS (SELECT a.g AS i, b.g AS j, sum(a.a * b.a) AS l FROM both_ a JOIN both_ b ON a.o = b.o AND a.g < b.g GROUP BY ALL),
tom AS (SELECT adj.i, adj.j, abs((coalesce(l, 0) + a) / ({{d}} + 1 - a)) AS t FROM adj LEFT JOIN l ON l.i = adj.i AND l.j = adj.j JOIN k ki ON ki.g = adj.i JOIN k kj ON kj.g = adj.j)"""


def _dim_adjacency(spark, sf_dir):
    return network.adjacency(network.correlation(fx.dim(spark, sf_dir)), "signed hybrid", 2)


@query(TOM_SQL.format(d="least(ki.k, kj.k)") + "SELECT i, j, round(t, 6) AS t FROM tom")
def n6_tom_min(spark, sf_dir):
    return rounded(network.tom(_dim_adjacency(spark, sf_dir)), "t")


@query(TOM_SQL.format(d="least(ki.k, kj.k)") + "SELECT i, j, round(t, 6) AS t FROM tom")
def n6_tom_tiles(spark, sf_dir):
    return rounded(network.tom(_dim_adjacency(spark, sf_dir), plan="tile"), "t")


@query(TOM_SQL.format(d="(ki.k + kj.k) / 2") + "SELECT i, j, round(t, 6) AS t FROM tom")
def n6_tom_mean_block(spark, sf_dir):
    return rounded(network.tom(_dim_adjacency(spark, sf_dir), "mean", plan="block"), "t")


@query(TOM_SQL.format(d="least(ki.k, kj.k)") + "SELECT i, j, round(1 - t, 8) AS d FROM tom")
def n7_diss_tom(spark, sf_dir):
    return network.dissimilarity(network.tom(_dim_adjacency(spark, sf_dir)))


@query(f"WITH {fx.EMB}, {R}, {ADJ.format(s=SIGNED, p=15)}, {BOTH} SELECT g AS gene_id, round(k, 6) AS k FROM k")
def n8_soft_connectivity(spark, sf_dir):
    return rounded(network.soft_connectivity(fx.emb(spark, sf_dir)), "k")


SUPP_ADJ = f"WITH {fx.SUPP}, {fx.SUPP_MODULES}, {R}, {ADJ.format(s=HYBRID, p=3)}, {BOTH}"


@query(SUPP_ADJ + """, s AS (SELECT x.gene_id, x.module, sum(a) AS t, sum(a) FILTER (x.module = y.module) AS w FROM both_ JOIN genes x ON x.gene_id = g JOIN genes y ON y.gene_id = o GROUP BY ALL),
z AS (SELECT module, count(*) AS n FROM genes GROUP BY module)
SELECT gene_id, module, round(t, 6) AS k_total, round(CASE WHEN n < 3 THEN 0 ELSE coalesce(w, 0) END, 6) + 0.0 AS k_within, round(t - CASE WHEN n < 3 THEN 0 ELSE coalesce(w, 0) END, 6) + 0.0 AS k_out,
 round(2 * CASE WHEN n < 3 THEN 0 ELSE coalesce(w, 0) END - t, 6) + 0.0 AS k_diff FROM s JOIN z USING (module)""")
def n10_intramodular(spark, sf_dir):
    return rounded(network.intramodular_of(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir), "signed hybrid", 3), "k_total", "k_within", "k_out", "k_diff")


@query(f"""WITH {fx.EMB}, {fx.EMB_MODULES}, {R}, {ADJ.format(s=HYBRID, p=6)}, {BOTH}, c AS (SELECT x.module, x.gene_id, 1 + coalesce(sum(a) FILTER (y.module = x.module), 0) AS connectivity
 FROM genes x LEFT JOIN both_ ON g = x.gene_id LEFT JOIN genes y ON y.gene_id = o GROUP BY ALL)
SELECT module, gene_id, round(connectivity, 6) AS connectivity, nth::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(connectivity, 9) DESC, gene_id) AS nth FROM c) WHERE nth <= 10""")
def n11_hub_genes(spark, sf_dir):
    return rounded(network.hub_genes_of(fx.emb(spark, sf_dir), fx.emb_modules(spark, sf_dir), "signed hybrid", 6), "connectivity").select("module", "gene_id", "connectivity", "rank")


Z = "z AS (SELECT sample_id, gene_id, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w END AS value FROM expr WINDOW w AS (PARTITION BY gene_id))"
AVERAGE = f"WITH {fx.SUPP}, {fx.SUPP_MODULES}, {Z}, me AS (SELECT sample_id, module, avg(value) AS value FROM z JOIN genes USING (gene_id) GROUP BY ALL)"


def _average(spark, sf_dir):
    return modules.average_expression(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir))


@query(AVERAGE + "SELECT sample_id, module, round(value, 6) + 0.0 AS value FROM me")
def m3_average_expression(spark, sf_dir):
    return rounded(_average(spark, sf_dir), "value")


@query(AVERAGE + "SELECT z.gene_id, m.module, round(corr(z.value, m.value), 6) + 0.0 AS r FROM z JOIN me m USING (sample_id) GROUP BY ALL")
def n12_signed_kme(spark, sf_dir):
    return rounded(modules.signed_kme(fx.supp(spark, sf_dir), _average(spark, sf_dir)), "r")


def _eigengenes(expr: str = "expr", keys: str = "module") -> str:
    """Eigengenes as SQL: the Gram matrix of the samples, squared again and again (to the power of 8,192), is the projector on its first vector; signs by the mean."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    of = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    out = f"""zz AS (SELECT {keys}, gene_id, sample_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM {expr} JOIN genes USING (gene_id) WINDOW w AS (PARTITION BY {keys}, gene_id)),
q0 AS (SELECT {of("a")}, a.sample_id AS i, b.sample_id AS j, sum(a.z * b.z) AS v FROM zz a JOIN zz b ON {on} AND a.gene_id = b.gene_id GROUP BY ALL)"""
    for k in range(13):
        out += f""", t{k} AS (SELECT {keys}, sum(v) FILTER (i = j) AS t FROM q{k} GROUP BY ALL), q{k + 1} AS MATERIALIZED (SELECT {of("a")}, a.i, b.j, sum(a.v * b.v / (b.t * b.t)) AS v FROM q{k} a JOIN (FROM q{k} JOIN t{k} USING ({keys})) b ON {on} AND a.j = b.i GROUP BY ALL)"""
    return out + f""", col AS (SELECT {keys}, arg_max(i, v) AS j FROM q13 WHERE i = j GROUP BY ALL), vec AS (SELECT {keys}, i AS sample_id, v / sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS v FROM q13 JOIN col USING ({keys}, j)),
mean AS (SELECT {keys}, sample_id, avg(z) AS m FROM zz GROUP BY ALL), turn AS (SELECT {keys}, CASE WHEN CASE WHEN abs(sum(v * m)) <= 1e-9 * sqrt(sum(m * m)) THEN arg_min(v, sample_id) ELSE sum(v * m) END < 0 THEN -1 ELSE 1 END AS sign FROM vec JOIN mean USING ({keys}, sample_id) GROUP BY ALL),
me AS (SELECT {keys}, sample_id, v * sign AS value FROM vec JOIN turn USING ({keys}))"""


EIGEN = f"WITH {fx.SUPP}, {fx.SUPP_MODULES}, {_eigengenes()} "


@query(EIGEN + "SELECT sample_id, module, round(value, 6) + 0.0 AS value FROM me")
def m2_eigengene(spark, sf_dir):
    return rounded(modules.eigengenes(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir)), "value")


@query(EIGEN + ", kme AS (SELECT e.gene_id, g.module, corr(e.value, m.value) AS r FROM expr e JOIN genes g USING (gene_id) JOIN me m ON m.sample_id = e.sample_id AND m.module = g.module GROUP BY ALL) SELECT module, round(avg(r * r), 6) AS explained FROM kme GROUP BY module")
def m2_variance_explained(spark, sf_dir):
    genes = fx.supp_modules(spark, sf_dir)
    me = modules.eigengenes(fx.supp(spark, sf_dir), genes)
    return rounded(modules.variance_explained(modules.signed_kme(fx.supp(spark, sf_dir), me), genes), "explained")


@query(AVERAGE + "SELECT a.module AS i, b.module AS j, round(1 - corr(a.value, b.value), 6) + 0.0 AS d FROM me a JOIN me b ON a.sample_id = b.sample_id AND a.module < b.module GROUP BY ALL")
def m6_me_dissimilarity(spark, sf_dir):
    return rounded(modules.me_dissimilarity(_average(spark, sf_dir)), "d")


SETS = AVERAGE + """, sets AS (SELECT left(sample_id, 4)::INT % 2 AS set_id, * FROM me),
diss AS (SELECT a.set_id, a.module AS i, b.module AS j, 1 - corr(a.value, b.value) AS d FROM sets a JOIN sets b ON a.set_id = b.set_id AND a.sample_id = b.sample_id AND a.module < b.module GROUP BY ALL)"""


def _sets(spark, sf_dir):
    me = _average(spark, sf_dir).withColumn("set_id", F.substring("sample_id", 1, 4).cast("int") % 2)
    return modules.me_dissimilarity(me, keys=("set_id",))


@query(SETS + "SELECT i, j, round(quantile_cont(d, 0.75), 6) + 0.0 AS d FROM diss GROUP BY ALL")
def m7_consensus_quantile(spark, sf_dir):
    return rounded(modules.consensus(_sets(spark, sf_dir), "quantile", 0.25), "d")


@query(SETS + "SELECT i, j, round(max(d), 6) + 0.0 AS d FROM diss GROUP BY ALL")
def m8_consensus_max(spark, sf_dir):
    return rounded(modules.consensus(_sets(spark, sf_dir), "consensus"), "d")


@query(SETS + "SELECT i, j, round(avg(d), 6) + 0.0 AS d FROM diss GROUP BY ALL")
def m8_consensus_majority(spark, sf_dir):
    return rounded(modules.consensus(_sets(spark, sf_dir), "majority"), "d")


@query(SETS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY d, i, j) AS nth FROM diss), means AS (SELECT nth, avg(d) AS m FROM ranked GROUP BY nth)
SELECT set_id, i, j, round(avg(m) OVER (PARTITION BY set_id, d), 6) + 0.0 AS d FROM ranked JOIN means USING (nth)""")
def w3_equalized_quantiles(spark, sf_dir):
    return rounded(modules.equalize_quantiles(_sets(spark, sf_dir)), "d")


@query(SETS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY d, i, j) AS nth FROM diss), means AS (SELECT nth, median(d) AS m FROM ranked GROUP BY nth)
SELECT set_id, i, j, round(avg(m) OVER (PARTITION BY set_id, d), 6) + 0.0 AS d FROM ranked JOIN means USING (nth)""")
def w3_equalized_quantiles_median(spark, sf_dir):
    return rounded(modules.equalize_quantiles(_sets(spark, sf_dir), "median"), "d")


COLOR_LIST = "[" + ", ".join(f"'{c}'" for c in COLORS) + "]"


@query(f"""WITH n AS (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY l_suppkey), numbered AS (SELECT l_suppkey, (row_number() OVER (ORDER BY c DESC, l_suppkey) - 1)::INT AS number FROM n)
SELECT l_suppkey, number, CASE WHEN number = 0 THEN 'grey' WHEN (number - 1) // {len(COLORS)} = 0 THEN {COLOR_LIST}[(number - 1) % {len(COLORS)} + 1]
 ELSE {COLOR_LIST}[(number - 1) % {len(COLORS)} + 1] || '.' || ((number - 1) // {len(COLORS)})::VARCHAR END AS color FROM numbered""")
def m1_label_colors(spark, sf_dir):
    from pyspark.sql import Window as W

    sizes = fx.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    numbered = sizes.select("l_suppkey", (F.row_number().over(W.orderBy(F.desc("c"), "l_suppkey")) - 1).alias("number"))  # a row a supplier
    return modules.labels_to_colors(numbered, COLORS)


@query(f"WITH {fx.SUPP_MODULES} SELECT gene_id, module, (dense_rank() OVER (ORDER BY module) - 1)::INT AS module_label FROM genes")
def m11_module_labels(spark, sf_dir):
    return modules.module_labels(fx.supp_modules(spark, sf_dir)).select("gene_id", "module", "module_label")


@query(f"WITH {fx.SUPP}, {Z} SELECT sample_id, gene_id, round(value, 6) + 0.0 AS value FROM z")
def w5_zscore(spark, sf_dir):
    return rounded(network.zscores(fx.supp(spark, sf_dir)), "value").select("sample_id", "gene_id", "value")


@query(f"WITH {fx.SUPP} SELECT sample_id, gene_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) + 0.0 AS value FROM expr WINDOW w AS (PARTITION BY gene_id)")
def w6_minmax(spark, sf_dir):
    return rounded(network.min_max(fx.supp(spark, sf_dir)), "value").select("sample_id", "gene_id", "value")


# --- traits ----------------------------------------------------------------------------------------
TRAITS = fx.MONTHS + """, traits AS (SELECT sample_id, 'year' AS trait, year::DOUBLE AS value FROM samples UNION ALL SELECT sample_id, 'half', (half = 'H2')::INT::DOUBLE FROM samples
  UNION ALL SELECT sample_id, q, (quarter = q)::INT::DOUBLE FROM samples, (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) v(q))"""


@query(f"WITH {TRAITS} SELECT sample_id, trait, value FROM traits")
def t1_trait_encoding(spark, sf_dir):
    return traits.encode_traits(fx.months(spark, sf_dir))


ODD, EVEN = "exp(lgamma(k + 1) - lgamma(k + 1.5)) * 0.886226925452758", "exp(lgamma(k + 0.5) - lgamma(k + 1)) / 1.772453850905516"
TRAIT_SQL = AVERAGE + ", " + TRAITS + """, rn AS (SELECT module, trait, corr(m.value, t.value) AS r, count(*) AS n FROM me m JOIN traits t USING (sample_id) GROUP BY ALL),
a AS (SELECT *, (n - 2)::INT AS v, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS th FROM rn),
p AS (SELECT module, trait, r, n, CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * (SELECT coalesce(sum(""" + ODD + """ * pow(cos(th), 2 * k + 1)), 0) FROM range(0, (v - 1) // 2) x(k)))
 ELSE 1 - sin(th) * (SELECT sum(""" + EVEN + """ * pow(cos(th), 2 * k)) FROM range(0, v // 2) x(k)) END AS p FROM a)"""


@query(TRAIT_SQL + "SELECT module, trait, round(r, 6) + 0.0 AS r, n, round(greatest(p, 0), 6) + 0.0 AS p FROM p")
def t2_module_trait(spark, sf_dir):
    return rounded(traits.module_trait(_average(spark, sf_dir), traits.encode_traits(fx.months(spark, sf_dir))), "r", "p")


@query(AVERAGE + ", " + fx.MONTHS + """SELECT module, half || '_' || quarter AS key, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, count(value) AS n FROM me JOIN samples USING (sample_id) GROUP BY ALL""")
def v5_eigengene_by_trait(spark, sf_dir):
    return rounded(traits.eigengene_by_trait(_average(spark, sf_dir), fx.months(spark, sf_dir), ["half", "quarter"]), "mean", "sd")


@query(SCAN + FIT + "SELECT power, round(-sign(slope) * r_sq, 5) + 0.0 AS signed_r_sq, round(avg(k), 6) AS mean_k FROM sft JOIN kk USING (power) GROUP BY power, slope, r_sq")
def v1_power_plot(spark, sf_dir):
    p = lookup.power_plot(network.soft_threshold_table(_powers(spark, sf_dir)))
    return p.select("power", (F.round("signed_r_sq", 5) + 0.0).alias("signed_r_sq"), r6("mean_k").alias("mean_k"))


# --- comparison --------------------------------------------------------------------------------------
WITH_OVERLAPS = "WITH " + fx.CUSTOMER_NETWORKS + OVERLAPS


def _compared(spark, sf_dir):
    return compare.compare_networks(fx.customer_networks(spark, sf_dir))


@query(WITH_OVERLAPS + "SELECT network1, module1, network2, module2, round(inter / (size1 + size2 - inter), 6) AS jaccard, round(inter / size2, 6) AS fraction, inter FROM full_")
def x1_jaccard_fraction(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).select("network1", "module1", "network2", "module2", "jaccard", "fraction", "inter"), "jaccard", "fraction")


FISHER = f"""SELECT network1, module1, network2, module2, round(least(1, (SELECT sum(exp({lchoose("size1", "k")} + {lchoose("n - size1", "size2 - k")} - {lchoose("n", "size2")}))
 FROM range(greatest(inter, size1 + size2 - n), least(size1, size2) + 1) x(k))), 6) + 0.0 AS p FROM full_"""


@query(WITH_OVERLAPS + FISHER)
def x3_fisher(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).select("network1", "module1", "network2", "module2", "p"), "p")


@query(WITH_OVERLAPS + ", names AS (SELECT DISTINCT network1 || ':' || module1 AS name, network1 AS network FROM full_) SELECT network1 || ':' || module1 AS row, network2 || ':' || module2 AS column, round(inter / (size1 + size2 - inter), 6) AS value FROM full_"
       " UNION ALL SELECT a.name, b.name, CASE WHEN a.name = b.name THEN 1.0 ELSE 0.0 END FROM names a JOIN names b USING (network)")
def x4_jaccard_matrix(spark, sf_dir):
    return rounded(compare.similarity_matrix(_compared(spark, sf_dir)), "value")


@query(WITH_OVERLAPS + "SELECT network1, module1, network2, module2, inter, round(inter / size2, 6) AS fraction FROM full_ WHERE network1 = 'single_cell' OR network2 = 'single_cell'")
def x5_marker_overlap(spark, sf_dir):
    c = _compared(spark, sf_dir).where("network1 = 'single_cell' or network2 = 'single_cell'")
    return rounded(c.select("network1", "module1", "network2", "module2", "inter", "fraction"), "fraction")


@query(WITH_OVERLAPS + "SELECT network1 || ':' || module1 AS i, network2 || ':' || module2 AS j, round(inter / (size1 + size2 - inter), 6) AS jaccard FROM full_ WHERE network1 || ':' || module1 < network2 || ':' || module2 AND inter / (size1 + size2 - inter) >= 0.1")
def p11_similar_modules(spark, sf_dir):
    return rounded(compare.similar_modules(_compared(spark, sf_dir)), "jaccard")


BUBBLE = WITH_OVERLAPS + f", ps AS ({FISHER.replace('round(least', 'least').replace(', 6) + 0.0 AS p', ' AS p')}) SELECT network1, module1, network2, module2, round(inter / size2, 6) AS fraction, round(coalesce(CASE WHEN p > 0 THEN -log10(p) END, max(-log10(p)) FILTER (p > 0) OVER () + 1), 5) + 0.0 AS log_p FROM full_ JOIN ps USING (network1, module1, network2, module2)"


@query(BUBBLE)
def v6_bubble(spark, sf_dir):
    b = compare.bubble(_compared(spark, sf_dir))
    return b.withColumns({"fraction": r6("fraction"), "log_p": F.round("log_p", 5) + 0.0})


ENRICH = f"""WITH s AS (SELECT n_name AS term, c_custkey::VARCHAR AS gene_id FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT c_mktsegment AS module, c_custkey::VARCHAR AS gene_id FROM customer),
t AS (SELECT count(*) AS n FROM customer), a AS (SELECT module, count(*) AS size1 FROM m GROUP BY ALL), b AS (SELECT term, count(*) AS size2 FROM s GROUP BY ALL),
o AS (SELECT module, term, count(*) AS x, string_agg(gene_id, ';' ORDER BY gene_id) AS genes FROM m JOIN s USING (gene_id) GROUP BY ALL),
p AS (SELECT *, least(1, (SELECT sum(exp({lchoose("size1", "k")} + {lchoose("n - size1", "size2 - k")} - {lchoose("n", "size2")})) FROM range(greatest(x, size1 + size2 - n), least(size1, size2) + 1) r(k))) AS p,
 x * (n - size2 - size1 + x) / nullif((size1 - x) * (size2 - x), 0) AS odds FROM o JOIN a USING (module) JOIN b USING (term) CROSS JOIN t),
q AS (SELECT *, least(1, p * count(*) OVER (PARTITION BY module) / row_number() OVER (PARTITION BY module ORDER BY p)) AS raw FROM p)
SELECT module, term, x::VARCHAR || '/' || size2::VARCHAR AS overlap, round(p, 6) AS p, round(odds, 5) AS odds_ratio, genes, round(min(raw) OVER (PARTITION BY module ORDER BY p DESC), 6) AS p_adjusted, round(-ln(p) * odds, 5) + 0.0 AS combined_score FROM q"""


@query(ENRICH)
def e1_enrichment(spark, sf_dir):
    c = fx.read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string").alias("gene_id")
    sets = c.join(fx.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"), key)
    report = compare.enrichment(c.select(F.col("c_mktsegment").alias("module"), key), sets)
    return rounded(report, "p", "p_adjusted").withColumns({k: F.round(k, 5) + 0.0 for k in ("odds_ratio", "combined_score")})


# --- clustering -------------------------------------------------------------------------------------------
@query(f"WITH {fx.EMB} SELECT a.gene_id AS i, b.gene_id AS j, round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS d FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY ALL")
def c1_distance(spark, sf_dir):
    return rounded(cluster.euclidean(fx.emb(spark, sf_dir)), "d")


@query(MONTHS_APART + ' SELECT "left", "right", node, round(height, 6) AS height, size, round FROM dendro')
def c2_linkage(spark, sf_dir):
    d = cluster.euclidean(fx.supp(spark, sf_dir), "sample_id", "gene_id")
    return rounded(cluster.linkage(d, fx.months(spark, sf_dir).select(F.col("sample_id").alias("id"))), "height")


@query()
def c6_module_detection(spark, sf_dir):
    """Modules of suppliers: overlap network, average-linkage tree, cut, size filter, left-over genes to the nearest module, colours."""
    from loomnet.plans.analysis import detect_modules

    return detect_modules(fx.supp(spark, sf_dir), Config(min_module_size=5), power=2)


@query()
def m10_merge(spark, sf_dir):
    return modules.merge_close_modules(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir), cut=0.2)


SUB_TOM = SUPP_ADJ + """, l AS (SELECT a.g AS i, b.g AS j, sum(a.a * b.a) AS l FROM both_ a JOIN both_ b ON a.o = b.o AND a.g < b.g GROUP BY ALL),
tom AS (SELECT adj.i, adj.j, abs((coalesce(l, 0) + a) / (least(ki.k, kj.k) + 1 - a)) AS t FROM adj LEFT JOIN l ON l.i = adj.i AND l.j = adj.j JOIN k ki ON ki.g = adj.i JOIN k kj ON kj.g = adj.j),
me AS (SELECT sample_id, module, avg(value) AS value FROM (SELECT sample_id, gene_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS value FROM expr WINDOW w AS (PARTITION BY gene_id)) JOIN genes USING (gene_id) GROUP BY ALL),
kme AS (SELECT e.gene_id, g.module, corr(e.value, m.value) AS r FROM expr e JOIN genes g USING (gene_id) JOIN me m ON m.sample_id = e.sample_id AND m.module = g.module GROUP BY ALL),
top AS (SELECT gene_id, module, r, nth FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(r, 9) DESC, gene_id) AS nth FROM kme WHERE module IN ('ASIA', 'EUROPE')) WHERE nth <= 10)
"""


def _subnetwork(spark, sf_dir, with_edges=True):
    genes, expr = fx.supp_modules(spark, sf_dir), fx.supp(spark, sf_dir)
    named = genes.join(fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("gene_id"), F.col("s_name").alias("name")), "gene_id")
    kme = modules.signed_kme(expr, modules.average_expression(expr, genes))
    overlap = lambda ids: network.tom_among(expr, ids, "signed hybrid", 3)
    return lookup.subnetwork(overlap, kme, named, ["ASIA", "EUROPE"], 10, 100, 0.0001, with_edges=with_edges)


@query(SUB_TOM + "SELECT i, j, round(t, 6) + 0.0 AS t FROM tom WHERE i IN (SELECT gene_id FROM top) AND j IN (SELECT gene_id FROM top) AND t >= 0.0001 AND t <> 0 ORDER BY round(t, 9) DESC, i, j LIMIT 100")
def n9_subnetwork_edges(spark, sf_dir):
    """The hundred largest overlaps among the ten best genes of each of two modules."""
    return rounded(_subnetwork(spark, sf_dir)[1].select("i", "j", "t"), "t")


@query(SUB_TOM + "SELECT gene_id, gene_id AS label, module, module AS color, 'dot' AS shape, gene_id || chr(10) || 'name: ' || s_name AS title, round(r, 6) + 0.0 AS r, nth::INT AS rank FROM top JOIN supplier ON s_suppkey::VARCHAR = gene_id")
def s14_subnetwork_nodes(spark, sf_dir):
    return rounded(_subnetwork(spark, sf_dir, with_edges=False)[0], "r")


# --- further entries of the inventory -----------------------------------------------------------------------
@query(f"WITH {fx.SUPP} SELECT sample_id, gene_id, value FROM expr")
def s1_csv_scan(spark, sf_dir):
    """A wide table written as delimited text and scanned again."""
    path = shared_path(spark, "csv")
    tables.write_expression(fx.supp(spark, sf_dir), path, sep=";")
    return tables.read_expression(spark, path, sep=";")


@query(f"WITH {fx.SUPP} SELECT sample_id, gene_id, value FROM expr")
def s3_sparse_matrix(spark, sf_dir):
    """Months by suppliers as compressed rows with their row and column tables; months without a cell are 0."""
    cells = fx.supp(spark, sf_dir, filled=False).withColumn("column", F.col("gene_id").cast("long"))
    month = (F.substring("sample_id", 1, 4).cast("long") - 1990) * 12 + F.substring("sample_id", 6, 2).cast("long") - 1
    counts = cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).withColumn("row", month)
    every = spark.range(12 * 20).select(F.col("id").alias("at")).join(counts, F.col("at") == F.col("row"), "left")  # months since 1990
    indptr = every.select("at", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("row").orderBy("column")) - 1
    entries = cells.withColumn("row", month).withColumn("inside", inside).join(indptr, F.col("row") == F.col("at")).select((F.col("start") + F.col("inside")).alias("at"), "column", "value")
    obs, var = counts.select("row", "sample_id"), cells.select("column", "gene_id").distinct()
    return tables.expression(spark, sparse=(indptr, entries, obs, var))[0]


@query(f"WITH {fx.SUPP_MODULES} SELECT gene_id, module FROM genes")
def s6_saved_analysis(spark, sf_dir):
    path = shared_path(spark, "saved")
    tables.save({"membership": fx.supp_modules(spark, sf_dir)}, {"power": 6}, path)
    return tables.load(spark, path)[0]["membership"]


@query("SELECT c_custkey::VARCHAR AS gene_id, c_name AS gene_name, n_name AS go_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def s9_annotated_with(spark, sf_dir):
    """An annotation file with renamed attributes, filtered by a term."""
    path = shared_path(spark, "annotation")
    c = fx.read(spark, sf_dir, "customer").join(fx.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c.select("c_custkey", "c_name", "n_name").write.csv(path, sep="\t", header=True)
    annotation = tables.read_annotation(spark, path, ["c_custkey", "c_name", "n_name"], ["gene_id", "gene_name", "go_id"])
    return tables.annotated_with(annotation, "NATION_3")


@query("SELECT l_suppkey, CASE WHEN c > 26 THEN floor(26 + sqrt(c - 26))::BIGINT ELSE c END AS core FROM (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY l_suppkey)")
def f9_core_size(spark, sf_dir):
    n = fx.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    return n.select("l_suppkey", stats.core_size(F.col("c"), 50).alias("core"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, avg(nth) OVER (PARTITION BY l_suppkey, l_quantity) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS nth FROM lineitem)")
def w2_average_rank(spark, sf_dir):
    line = fx.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return modules.average_rank(line, "l_quantity", ["l_suppkey"]).drop("l_quantity")


@query(TOM_SQL.format(d="least(ki.k, kj.k)") + "SELECT i, j, round(t, 6) AS t FROM tom WHERE t >= 0.002 AND t <> 0")
def p12_tom_threshold(spark, sf_dir):
    return rounded(network.tom(_dim_adjacency(spark, sf_dir)).where("t >= 0.002 and t <> 0"), "t")


@query(TOM_SQL.format(d="least(ki.k, kj.k)") + "SELECT i, j, round(t, 6) AS t FROM tom ORDER BY round(t, 9) DESC, i, j LIMIT 50")
def o3_largest_edges(spark, sf_dir):
    return rounded(network.tom(_dim_adjacency(spark, sf_dir)).orderBy(F.desc(F.round("t", 9)), "i", "j").limit(50), "t")


@query(AVERAGE + "SELECT 'ME' || module AS name, substr('ME' || module, 3) AS color, count(*) AS n FROM me WHERE module <> 'ASIA' GROUP BY module")
def p10_p13_eigengene_names(spark, sf_dir):
    """Eigengenes named after their module, without the one that stands for no module (here ASIA)."""
    me = _average(spark, sf_dir).where("module <> 'ASIA'").withColumn("name", F.concat(F.lit("ME"), "module"))
    return me.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.expr("substring(name, 3)").alias("color"), "n")


@query(f"""WITH RECURSIVE {fx.DIM}, d AS (SELECT a.gene_id AS i, b.gene_id AS j, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY ALL),
h AS (SELECT quantile_cont(d, 0.02) AS h FROM d), e AS (SELECT i, j FROM d, h WHERE d <= h UNION SELECT j, i FROM d, h WHERE d <= h),
reach(id, other) AS (SELECT DISTINCT gene_id, gene_id FROM expr UNION SELECT reach.id, e.j FROM reach JOIN e ON e.i = reach.other) SELECT id, min(other) AS label FROM reach GROUP BY id""")
def c3_static_cut(spark, sf_dir):
    """Single-linkage clusters of dimensions at the height that two in a hundred distances stay below."""
    d = cluster.euclidean(fx.dim(spark, sf_dir))
    height = cluster.quantile(d, "d", 0.02)
    return cluster.cut_single(d, fx.dim(spark, sf_dir).select(F.col("gene_id").alias("id")).distinct(), height)


@query(f"""WITH {fx.SUPP_MODULES}, n AS (SELECT module, count(*) AS n FROM genes GROUP BY module), big AS (SELECT module, (row_number() OVER (ORDER BY n DESC, module))::INT AS number FROM n WHERE n >= 3)
SELECT gene_id AS id, module AS label, coalesce(number, 0) AS number FROM genes LEFT JOIN big USING (module)""")
def c8_size_filter(spark, sf_dir):
    return cluster.size_filter(fx.supp_modules(spark, sf_dir).select(F.col("gene_id").alias("id"), F.col("module").alias("label")), 3)


@query(f"WITH {fx.SUPP}, {fx.SUPP_MODULES}, sets AS (SELECT left(sample_id, 4)::INT % 2 AS set_id, * FROM expr), {_eigengenes('sets', 'set_id, module')} SELECT set_id, sample_id, module, round(value, 6) + 0.0 AS value FROM me")
def m4_multiset_eigengenes(spark, sf_dir):
    expr = fx.supp(spark, sf_dir).withColumn("set_id", F.substring("sample_id", 1, 4).cast("int") % 2)
    return rounded(modules.multiset_eigengenes(expr, fx.supp_modules(spark, sf_dir)), "value")


@query(f"{AVERAGE.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT a.module AS i, b.module AS j, 1 - corr(a.value, b.value) AS d FROM me a JOIN me b ON a.sample_id = b.sample_id AND a.module < b.module GROUP BY ALL), {LINK}, {LEAVES} SELECT id AS module, ord::INT AS ord FROM leaf")
def m9_module_order(spark, sf_dir):
    return modules.order_modules(_average(spark, sf_dir))


@query(f"{SETS.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT i, j, avg(d) AS d FROM diss GROUP BY i, j), {LINK}, {LEAVES} SELECT id AS module, ord::INT AS ord FROM leaf")
def m9_consensus_order(spark, sf_dir):
    me = _average(spark, sf_dir).withColumn("set_id", F.substring("sample_id", 1, 4).cast("int") % 2)
    return modules.consensus_order(me, "majority")


@query(f"""WITH RECURSIVE {fx.DIM}, d AS (SELECT a.gene_id AS i, b.gene_id AS j, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY ALL), {LINK}, {LEAVES},
{_flat("(SELECT avg(height) FROM dendro)", "SELECT DISTINCT gene_id AS id FROM expr")},
placed AS (SELECT id, label, ord, min(ord) OVER (PARTITION BY label) AS first FROM flat JOIN leaf USING (id)) SELECT id, label, row_number() OVER (ORDER BY first, label, ord) - 1 AS ord FROM placed""")
def c4_heatmap_rows(spark, sf_dir):
    """Dimensions in the order of a heatmap's rows: flat clusters of an average-linkage tree, each in leaf order."""
    expr = fx.dim(spark, sf_dir)
    items = expr.select(F.col("gene_id").alias("id")).distinct()
    tree = cluster.linkage(cluster.euclidean(expr), items)
    return cluster.heatmap_rows(tree, items, tree.agg(F.avg("height")).first()[0])


@query(WITH_OVERLAPS + "SELECT network1, module1, network2, module2, inter, round(inter / (size1 + size2 - inter), 6) AS jaccard FROM full_")
def s7_saved_comparison(spark, sf_dir):
    from loomnet.plans import analysis

    path = shared_path(spark, "comparison")
    analysis.save_comparison(_compared(spark, sf_dir).select("network1", "module1", "network2", "module2", "inter", "jaccard"), path)
    return rounded(analysis.load_comparison(spark, path), "jaccard")


@query(TRAIT_SQL + "SELECT module, trait, printf('%.2f', r) || chr(10) || '(' || printf('%.3f', greatest(p, 0)) || ')' AS label FROM p")
def v3_heatmap_labels(spark, sf_dir):
    return traits.heatmap_labels(traits.module_trait(_average(spark, sf_dir), traits.encode_traits(fx.months(spark, sf_dir)))).select("module", "trait", "label")


@query(AVERAGE + """SELECT e.sample_id, e.gene_id, round((e.value - min(e.value) OVER w) / (max(e.value) OVER w - min(e.value) OVER w), 6) + 0.0 AS value, round(m.value, 6) + 0.0 AS eigengene
FROM expr e JOIN genes g ON g.gene_id = e.gene_id AND g.module = 'ASIA' JOIN me m ON m.module = 'ASIA' AND m.sample_id = e.sample_id WINDOW w AS (PARTITION BY e.gene_id)""")
def v4_module_heatmap(spark, sf_dir):
    return rounded(modules.module_heatmap(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir), _average(spark, sf_dir), "ASIA"), "value", "eigengene")


@query(f"WITH {fx.SUPP}, {R}, m AS (SELECT i, j, r AS v FROM pairs UNION ALL SELECT j, i, r FROM pairs) SELECT count(*) FILTER (v < -1 OR v > 1) AS out_of_range, 0::BIGINT AS asymmetric, 0::BIGINT AS unmatched FROM m")
def n0_checked_matrix(spark, sf_dir):
    return network.checked_correlation(fx.supp(spark, sf_dir))


@query(f"""WITH {fx.SUPP}, w AS (SELECT a.gene_id AS i, b.gene_id AS j, a.value AS x, b.value AS y, 1 + right(a.sample_id, 2)::INT AS w FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id)
SELECT i, j, round((sum(w) * sum(w*x*y) - sum(w*x) * sum(w*y)) / sqrt((sum(w) * sum(w*x*x) - pow(sum(w*x), 2)) * (sum(w) * sum(w*y*y) - pow(sum(w*y), 2))), 6) + 0.0 AS r FROM w GROUP BY i, j""")
def n1_weighted_correlation(spark, sf_dir):
    """Correlation with a weight for every sample, here one more than the month."""
    e = fx.supp(spark, sf_dir)
    w = e.select("sample_id").distinct().select("sample_id", (1 + F.substring("sample_id", 6, 2).cast("int")).alias("weight"))
    return rounded(network.correlation(e, weights=w), "r")


def _gaps(weight: str) -> str:
    """Correlations over shared days of users; weight is SQL over x, y and the two genes."""
    return f"""WITH {fx.EVENTS}, b AS (SELECT gene_id, sample_id, value - avg(value) OVER (PARTITION BY gene_id) AS value FROM expr),
w AS (SELECT a.gene_id AS i, b.gene_id AS j, a.value AS x, b.value AS y, {weight} AS w FROM b a JOIN b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id),
s AS (SELECT i, j, sum(w) AS n, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*y*y) AS syy, sum(w*x*y) AS sxy FROM w GROUP BY i, j)
SELECT i, j, CASE WHEN n*sxx - sx*sx > 1e-12 * n*sxx AND n*syy - sy*sy > 1e-12 * n*syy THEN round(greatest(-1, least(1, (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)))), 6) + 0.0 END AS r FROM s"""


@query(_gaps("1.0"))
def n1_correlation_gaps(spark, sf_dir):
    """Users have events on some days only: blocks with masks."""
    return rounded(network.correlation(fx.events(spark, sf_dir), plan="masked"), "r")


@query(_gaps("(1 + right(a.sample_id, 1)::INT % 3) * (1 + length(a.gene_id)) * (1 + right(a.sample_id, 1)::INT % 3) * (1 + length(b.gene_id))"))
def n1_weighted_gaps(spark, sf_dir):
    """The same with a weight for every observation, from the last digit of the day and the length of the user's id."""
    e = fx.events(spark, sf_dir)
    w = e.select("sample_id", "gene_id", ((1 + F.substring("sample_id", -1, 1).cast("int") % 3) * (1 + F.length("gene_id"))).alias("weight"))
    return rounded(network.correlation(e, plan="masked", weights=w), "r")


@query(f"""WITH {fx.SUPP}, pairs AS (SELECT a.gene_id AS i, b.gene_id AS j, corr(a.value, b.value) AS r FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id <> b.gene_id
WHERE right(b.gene_id, 1) = '0' GROUP BY ALL) SELECT i, j, round(pow({SIGNED}, 6), 6) + 0.0 AS a FROM pairs""")
def n2_adjacency_selected(spark, sf_dir):
    """Adjacencies of all suppliers to those whose key ends in 0."""
    e = fx.supp(spark, sf_dir)
    some = e.where(F.col("gene_id").endswith("0")).select("gene_id")
    return rounded(network.adjacency(network.correlation(e, plan="masked", select=some), "signed", 6), "a")


@query(EIGEN + "SELECT sample_id, module, 1 AS component, round(value, 6) + 0.0 AS value FROM me")
def m2_component_by_blocks(spark, sf_dir):
    """The first component without a product of samples by samples."""
    out = components.principal_components(fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir), 1)
    return rounded(out.select("sample_id", "module", "component", "value"), "value")


@query()
def m2_three_components(spark, sf_dir):
    """Three components of each module and how much of its genes each explains."""
    expr, genes = fx.supp(spark, sf_dir), fx.supp_modules(spark, sf_dir)
    return components.component_explained(expr, genes, components.principal_components(expr, genes, 3))


GAPS = f"""WITH {fx.EVENTS}, genes AS (SELECT DISTINCT gene_id, 'm' || (gene_id::BIGINT % 3)::VARCHAR AS module FROM expr)"""


def _gappy(spark, sf_dir):
    """Users with gaps, in three modules by their id."""
    expr = fx.events(spark, sf_dir)
    return expr, expr.select("gene_id", F.concat(F.lit("m"), (F.col("gene_id").cast("long") % 3).cast("string")).alias("module")).distinct()


@query(GAPS + """, own AS (SELECT * FROM expr JOIN genes USING (gene_id)), p AS (SELECT count(DISTINCT sample_id) AS p FROM expr),
far AS (SELECT a.module, a.gene_id, b.gene_id AS giver, sum(pow(a.value - b.value, 2)) * any_value(p) / count(*) AS d FROM own a JOIN own b ON a.module = b.module AND a.sample_id = b.sample_id AND a.gene_id <> b.gene_id, p GROUP BY ALL),
gap AS (SELECT module, gene_id, sample_id FROM genes CROSS JOIN (SELECT DISTINCT sample_id FROM expr) ANTI JOIN expr USING (gene_id, sample_id)),
near AS (SELECT g.module, g.gene_id, g.sample_id, o.value FROM gap g JOIN far f ON f.module = g.module AND f.gene_id = g.gene_id JOIN own o ON o.gene_id = f.giver AND o.sample_id = g.sample_id
  QUALIFY row_number() OVER (PARTITION BY g.gene_id, g.sample_id ORDER BY d, giver) <= 10),
given AS (SELECT gene_id, sample_id, avg(value) AS value FROM near GROUP BY ALL), middle AS (SELECT module, sample_id, avg(value) AS value FROM own GROUP BY ALL)
SELECT sample_id, gene_id, round(value, 6) + 0.0 AS value FROM expr UNION ALL
SELECT g.sample_id, g.gene_id, round(coalesce(n.value, m.value), 6) + 0.0 FROM gap g LEFT JOIN given n USING (gene_id, sample_id) LEFT JOIN middle m ON m.module = g.module AND m.sample_id = g.sample_id WHERE coalesce(n.value, m.value) IS NOT NULL""")
def m2_imputed(spark, sf_dir):
    """Days without events from the ten nearest users of the module."""
    return rounded(components.impute_nearest(*_gappy(spark, sf_dir), 10), "value")


@query(GAPS + """, z AS (SELECT * FROM (SELECT module, gene_id, sample_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM expr JOIN genes USING (gene_id) WINDOW w AS (PARTITION BY gene_id)) WHERE z IS NOT NULL),
cov AS (SELECT a.module, a.gene_id AS i, b.gene_id AS j, coalesce(covar_samp(a.z, b.z), 0) AS c FROM z a JOIN z b ON a.module = b.module AND a.sample_id = b.sample_id GROUP BY ALL),
n AS (SELECT module, count(DISTINCT gene_id) AS n FROM z GROUP BY ALL), raw AS (SELECT module, i, pow(sum(pow(abs(c), 6)) / any_value(n), 3) AS k FROM cov JOIN n USING (module) GROUP BY ALL),
k AS (SELECT module, i, CASE WHEN max(k) OVER (PARTITION BY module) > 1 THEN k - 1 ELSE k END AS k FROM raw), hub AS (SELECT module, first(i ORDER BY k DESC, i) AS j, sum(k) AS total FROM k GROUP BY ALL),
w AS (SELECT module, i AS gene_id, sign(c) * k / total AS w FROM cov JOIN hub USING (module, j) JOIN k USING (module, i))
SELECT sample_id, module, round(sum(z * w) / any_value(n), 6) + 0.0 AS value FROM z JOIN w USING (module, gene_id) JOIN n USING (module) GROUP BY ALL""")
def m2_hub_profile(spark, sf_dir):
    return rounded(components.hub_profile(*_gappy(spark, sf_dir), 6), "value")


def _minimax(rounds: int) -> str:
    """Least largest steps over paths of up to 2^rounds steps."""
    out = "m0 AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d)"
    for k in range(rounds):
        out += f", m{k + 1} AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM m{k} UNION ALL SELECT a.i, b.j, greatest(a.d, b.d) FROM m{k} a JOIN m{k} b ON a.j = b.i AND a.i <> b.j) GROUP BY i, j)"
    return out


@query(f"""WITH {fx.SUPP}, d AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM expr a JOIN expr b ON a.gene_id = b.gene_id AND a.sample_id < b.sample_id GROUP BY ALL),
{_minimax(7)} SELECT d.i, d.j, round(d.d, 6) + 0.0 AS d FROM d JOIN m7 ON m7.i = d.i AND m7.j = d.j WHERE d.d <= m7.d""")
def c2_spanning_tree(spark, sf_dir):
    """The tree of months: an edge is in it exactly if no path around it has only smaller steps."""
    d = cluster.euclidean(fx.supp(spark, sf_dir), "sample_id", "gene_id")
    return rounded(cluster.spanning_tree(d, fx.months(spark, sf_dir).select(F.col("sample_id").alias("id"))).select("i", "j", "d"), "d")


@query(f"""WITH RECURSIVE {fx.SUPP}, {fx.SUPP_MODULES}, sets AS (SELECT left(sample_id, 4)::INT % 2 AS set_id, * FROM expr), {_eigengenes('sets', 'set_id, module')},
diss AS (SELECT i, j, max(d) AS d FROM (SELECT a.set_id, a.module AS i, b.module AS j, 1 - corr(a.value, b.value) AS d FROM me a JOIN me b ON a.set_id = b.set_id AND a.sample_id = b.sample_id AND a.module <> b.module GROUP BY ALL) GROUP BY ALL),
reach(id, other) AS (SELECT DISTINCT module, module FROM genes UNION SELECT reach.id, diss.j FROM reach JOIN diss ON diss.i = reach.other AND diss.d <= 0.9),
merged AS (SELECT gene_id, label AS module FROM genes JOIN (SELECT id AS module, min(other) AS label FROM reach GROUP BY id) USING (module)),
size AS (SELECT module, (row_number() OVER (ORDER BY count(*) DESC, module))::INT AS number FROM merged GROUP BY module) SELECT gene_id, module, number FROM merged JOIN size USING (module)""")
def m10_consensus_round(spark, sf_dir):
    """One round of merging modules that are near in both sets of years, by single linkage."""
    expr = fx.supp(spark, sf_dir).withColumn("set_id", F.substring("sample_id", 1, 4).cast("int") % 2)
    return modules.merge_on_consensus(expr, fx.supp_modules(spark, sf_dir), cut=0.9, linkage_method="single", rounds=1)


@query()
def m10_consensus_merge(spark, sf_dir):
    """Merging on the consensus of two sets of years until nothing is near any more."""
    expr = fx.supp(spark, sf_dir).withColumn("set_id", F.substring("sample_id", 1, 4).cast("int") % 2)
    return modules.merge_on_consensus(expr, fx.supp_modules(spark, sf_dir), cut=0.6, quantile=0.25, equalize="mean")
