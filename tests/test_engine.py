"""Every registered engine query against its SQL on the smallest tables, micro-cases by hand, invariants and planted modules."""

import math
import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomnet.functions import stats
from loomnet.model import Config
from loomnet.operators import branches, clean, cluster, compare, modules, network, traits
from loomnet.plans import analysis, queries
from loomnet.plans.runtime import materialize
from loomnet.sources import tables

sys.path.insert(0, os.path.dirname(__file__))
import tree_cut  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"m10_consensus_merge"}  # merge_on_consensus has a test of its own


def rows(df):
    columns = sorted(df.columns)
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(float(v), 4) + 0.0) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - SLOW))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def expr_of(spark, matrix, genes=None):
    matrix = np.asarray(matrix, float)
    genes = genes or [f"g{k:03d}" for k in range(matrix.shape[0])]
    return spark.createDataFrame([(f"s{j:03d}", g, float(v)) for g, row in zip(genes, matrix, strict=True) for j, v in enumerate(row) if not np.isnan(v)], "sample_id string, gene_id string, value double")


def test_missing_values_and_flat_genes(spark):
    x = [[1, 2, 3, 4, 5], [2, np.nan, 6, 8, 1], [7, 7, 7, 7, 7]]
    r = {(a.i, a.j): a.r for a in network.correlation(expr_of(spark, x)).collect()}
    both = [0, 2, 3, 4]
    assert r["g000", "g001"] == pytest.approx(np.corrcoef(np.array(x[0])[both], np.array(x[1])[both])[0, 1])
    assert r["g000", "g002"] is None
    good = {a.gene_id: a.good for a in clean.good_genes(expr_of(spark, x)).collect()}
    assert good == {"g000": True, "g001": True, "g002": False}
    assert network.correlation(expr_of(spark, x).where("false")).count() == 0


def test_plans_agree(spark):
    x = np.random.default_rng(1).normal(size=(40, 12))
    a = network.correlation(expr_of(spark, x), plan="join").toPandas().set_index(["i", "j"]).r
    b = network.correlation(expr_of(spark, x), plan="block").toPandas().set_index(["i", "j"]).r
    assert np.allclose(a.sort_index(), b.sort_index(), atol=1e-12)
    adj = network.adjacency(network.correlation(expr_of(spark, x)), "unsigned", 2)
    t, u = (network.tom(adj, plan=p).toPandas().set_index(["i", "j"]).t.sort_index() for p in ("join", "block"))
    assert np.allclose(t, u, atol=1e-12)
    assert ((t >= 0) & (t <= 1)).all()


def test_three_gene_overlap(spark):
    adj = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.4), ("b", "c", 0.0)], "i string, j string, a double")
    t = {(r.i, r.j): r.t for r in network.tom(adj).collect()}
    assert t["a", "b"] == pytest.approx((0.5 + 0) / (0.5 + 1 - 0.5))
    assert t["b", "c"] == pytest.approx(0.5 * 0.4 / (0.4 + 1))
    k = {r.gene_id: r.k for r in network.connectivity(adj).collect()}
    assert k == pytest.approx({"a": 0.9, "b": 0.5, "c": 0.4})


def test_scale_free_fit_of_equal_connectivity(spark):
    k = spark.createDataFrame([(1, f"g{i}", 2.0) for i in range(8)], "power int, gene_id string, k double")
    assert network.scale_free_fit(k).count() == 1


def test_student_and_fisher(spark):
    df = spark.createDataFrame([(0.5, 12), (0.5, 13), (1.0, 9), (0.1, 2)], "r double, n int")
    got = [r[0] for r in df.select(stats.student_p(F.col("r"), F.col("n"))).collect()]

    def tail(r, n):  # numeric integration of the density
        v, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        x = np.linspace(t, t + 4000, 4_000_001)
        y = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        return 2 * np.trapezoid(y, x)

    assert got[0] == pytest.approx(tail(0.5, 12), rel=1e-4) and got[1] == pytest.approx(tail(0.5, 13), rel=1e-4)
    assert got[2] == 0.0 and got[3] is None
    p = spark.createDataFrame([(3, 5, 4, 10), (0, 3, 3, 10), (10, 10, 10, 10)], "x long, a long, b long, n long")
    got = [tuple(r) for r in p.select(*[stats.hypergeometric_p(*(F.col(c) for c in "xabn"), s) for s in ("greater", "less", "two-sided")]).collect()]

    def exact(x, a, b, n):
        chance = lambda k: math.comb(a, k) * math.comb(n - a, b - k) / math.comb(n, b)
        support = range(max(0, a + b - n), min(a, b) + 1)
        return sum(chance(k) for k in support if k >= x), sum(chance(k) for k in support if k <= x), sum(chance(k) for k in support if chance(k) <= chance(x) * (1 + 1e-7))

    for g, w in zip(got, ((3, 5, 4, 10), (0, 3, 3, 10), (10, 10, 10, 10)), strict=True):
        assert g == pytest.approx(exact(*w), rel=1e-9)
    cases = [(x, a, b, n) for a, b, n in ((0, 5, 9), (4, 6, 9), (7, 7, 9), (40, 90, 400), (300, 350, 400)) for x in range(max(0, a + b - n), min(a, b) + 1, 3)]
    p = spark.createDataFrame(cases, "x long, a long, b long, n long")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in p.select("*", *[stats.hypergeometric_p(*(F.col(c) for c in "xabn"), s) for s in ("greater", "less", "two-sided")]).collect()}
    for w in cases:
        assert got[w] == pytest.approx(exact(*w), rel=1e-8, abs=1e-12), w


def brute_linkage(d, method):
    clusters = {k: [k] for k in range(len(d))}
    heights = []
    while len(clusters) > 1:
        f = {"average": np.mean, "single": np.min, "complete": np.max}[method]
        h, a, b = min((f(d[np.ix_(clusters[a], clusters[b])]), a, b) for a in clusters for b in clusters if a < b)
        heights.append(h)
        clusters[a] += clusters.pop(b)
    return sorted(heights)


@pytest.mark.parametrize("method", ["average", "single", "complete"])
def test_linkage_by_brute_force(spark, method):
    x = np.random.default_rng(3).normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    names = [f"n{k:02d}" for k in range(14)]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(14) for j in range(i + 1, 14)], "i string, j string, d double")
    items = spark.createDataFrame([(n,) for n in names], "id string")
    tree = cluster.linkage(pairs, items, method)
    assert sorted(r.height for r in tree.collect()) == pytest.approx(brute_linkage(d, method))
    if method == "single":
        cut = float(np.median(brute_linkage(d, method)))
        assert rows(cluster.cut_tree(tree, items, cut).toPandas()) == rows(cluster.cut_single(pairs, items, cut).toPandas())


def test_distances(spark):
    x = np.random.default_rng(6).normal(size=(9, 5))
    x[2, 1] = x[4, :3] = np.nan
    x[5] = x[6] + 1e-9
    x[7, :3], x[8, 3:] = np.nan, np.nan  # no cell in common
    got = {(r.i, r.j): r.d for r in cluster.euclidean(expr_of(spark, x)).collect()}
    names = [f"g{k:03d}" for k in range(9)]
    for i in range(9):
        for j in range(i + 1, 9):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            assert ((names[i], names[j]) in got) == both.any()
            if both.any():
                assert got[names[i], names[j]] == pytest.approx(np.sqrt(((x[i] - x[j])[both] ** 2).sum()), rel=1e-6)


def test_leaf_order(spark):
    tree = spark.createDataFrame([("a", "c", "a~1", 1.0, 2, 1), ("b", "d", "b~1", 1.0, 2, 1), ("b~1", "a~1", "b~2", 2.0, 4, 2), ("b~2", "e", "b~3", 3.0, 5, 3), ("x", "y", "x~1", 1.0, 2, 1)], "left string, right string, node string, height double, size long, round int")
    items = spark.createDataFrame([(k,) for k in "abcdexyz"], "id string")
    place = {r.id: r.ord for r in cluster.leaf_order(tree, items).collect()}
    assert sorted(place, key=place.get) == list("zbdacexy") and sorted(place.values()) == list(range(8))
    rows_ = {r.id: (r.label, r.ord) for r in cluster.heatmap_rows(tree, items, 1.5).collect()}
    assert sorted(rows_, key=lambda k: rows_[k][1]) == list("zbdacexy") and rows_["c"][0] == "a" and rows_["e"][0] == "e"


def test_module_order(spark):
    """Modules of like eigengenes stand side by side and grey is last, by one set or by consensus."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 40))
    own = {"m1": a, "m4": a + 0.1 * rng.normal(size=40), "m2": b, "m3": b + 0.1 * rng.normal(size=40), "grey": rng.normal(size=40)}
    me = spark.createDataFrame([(k % 2, f"s{k:02d}", m, float(v[k])) for m, v in own.items() for k in range(40)], "set_id int, sample_id string, module string, value double")
    for order in (modules.order_modules(me.drop("set_id")), modules.order_modules_by_set(me), modules.consensus_order(me, "majority")):
        place = {r.module: r.ord for r in order.collect()}
        assert sorted(place.values()) == list(range(5)) and place["grey"] == 4
        assert abs(place["m1"] - place["m4"]) == 1 and abs(place["m2"] - place["m3"]) == 1


def test_scatter_share():
    assert cluster.scatter_share(2) == 0.82 and cluster.scatter_share(0.5) == pytest.approx(0.685) and cluster.scatter_share(4) == 0.95
    with pytest.raises(ValueError):
        cluster.scatter_share(5)


def planted(seed=5):
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(4, 60))
    x = np.vstack([factors[k] + 0.3 * rng.normal(size=(12, 60)) for k in range(4)] + [rng.normal(size=(12, 60))])
    return x, np.repeat([0, 1, 2, 3, 4], 12)


def test_planted_modules(spark):
    x, truth = planted()
    found = analysis.detect_modules(expr_of(spark, x), Config(min_module_size=5), power=4).toPandas().sort_values("gene_id")
    for k in range(4):
        assert found.module[truth == k].nunique() == 1, k
    assert found.module[truth < 4].nunique() == 4


@pytest.mark.parametrize("seed", [5, 6])
def test_adaptive_cut_against_a_direct_version(spark, seed):
    """Agreement (adjusted Rand index) with the cut merge by merge, before any left-over item is given away and after."""
    x, truth = planted(seed)
    d = 1 - np.abs(np.corrcoef(x)) ** 2
    np.fill_diagonal(d, 0)
    names = [f"g{k:03d}" for k in range(len(d))]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))], "i string, j string, d double")
    items = spark.createDataFrame([(n,) for n in names], "id string")
    tree = materialize(cluster.linkage(pairs, items), "tree")
    given = {r.id: r.number for r in branches.hybrid_cut(tree, items, pairs, 5, 2, respect_tree=False).collect()}
    direct = tree_cut.adaptive_cut(d, 5)
    assert len(set(direct)) == 4 + (0 in direct)
    assert tree_cut.agreement(np.array([given[n] for n in names]), direct) >= 0.9


def test_eigengenes_against_svd(spark):
    x, truth = planted()
    expr = expr_of(spark, x)
    member = spark.createDataFrame([(f"g{k:03d}", f"m{t}") for k, t in enumerate(truth)], "gene_id string, module string")
    me = modules.eigengenes(expr, member).toPandas().pivot(index="sample_id", columns="module", values="value").sort_index()
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    for k in range(4):
        own = np.linalg.svd(z[truth == k])[2][0]
        own *= np.sign(own @ z[truth == k].mean(0))
        assert np.allclose(me[f"m{k}"], own, atol=1e-6)
        assert np.linalg.norm(me[f"m{k}"]) == pytest.approx(1)


def test_merge_close_modules(spark):
    x, truth = planted()
    names = np.where(truth == 0, np.where(np.arange(60) % 2, "a1", "a2"), np.char.add("m", truth.astype(str)))
    member = spark.createDataFrame([(f"g{k:03d}", str(n)) for k, n in enumerate(names)], "gene_id string, module string")
    merged = modules.merge_close_modules(expr_of(spark, x), member).toPandas()
    assert set(merged.module) == {"a1", "m1", "m2", "m3", "m4"}


def test_trait_encoding(spark):
    samples = spark.createDataFrame([("s1", "a", "x", 1.5, "k"), ("s2", "b", "y", None, "k"), ("s3", "c", None, 2.0, "k")], "sample_id string, three string, two string, number double, one string")
    got = {(r.sample_id, r.trait): r.value for r in traits.encode_traits(samples).collect()}
    assert {t for _, t in got} == {"a", "b", "c", "two", "number"}
    assert got["s1", "two"] == 0 and got["s2", "two"] == 1 and got["s3", "two"] is None and got["s2", "number"] is None and got["s2", "b"] == 1


def test_disjoint_and_equal_modules(spark):
    m = spark.createDataFrame([("A", "p", "1"), ("A", "p", "2"), ("A", "q", "3"), ("B", "r", "1"), ("B", "r", "2"), ("B", "s", "9")], "network string, module string, gene_id string")
    got = {(r.module1, r.module2): r for r in compare.compare_networks(m).collect()}
    assert got["p", "r"].jaccard == 1 and got["p", "s"].inter == 0 and got["q", "r"].fraction == 0
    assert got["p", "r"].p == pytest.approx(1 / math.comb(4, 2))
    assert compare.compare_networks(m.where("false")).count() == 0


def test_enrichment_golden_row(spark):
    """A published report row: 1 of 5 in a module of 69 out of 20000 has an odds ratio of 19927 / 272."""
    member = spark.createDataFrame([("red", f"g{k}") for k in range(69)], "module string, gene_id string")
    sets = spark.createDataFrame([("term", f"g{k}") for k in [0, 100, 101, 102, 103]], "term string, gene_id string")
    row = compare.enrichment(member, sets, background=20000).first()
    assert row.overlap == "1/5" and row.odds_ratio == pytest.approx(19927 / 272) and row.combined_score == pytest.approx(-math.log(row.p) * row.odds_ratio)


def test_sources_round_trip(spark, tmp_path):
    pd.DataFrame({"sample": ["s1", "s2"], "g1": [1.0, 2.0], "g.2": [3.0, None]}).to_csv(tmp_path / "x.csv", index=False)
    long = tables.read_expression(spark, str(tmp_path / "x.csv"))
    assert rows(long.toPandas()) == rows(pd.DataFrame({"sample_id": ["s1", "s2", "s1", "s2"], "gene_id": ["g1", "g1", "g.2", "g.2"], "value": [1.0, 2.0, 3.0, None]}))
    with pytest.raises(ValueError):
        tables.expression(spark)
    x, truth = planted()
    own = analysis.Analysis(expr_of(spark, x), config=Config(min_module_size=5, tpm_cutoff=-100.0)).find_modules(power=4)
    own.save(str(tmp_path / "saved"))
    again = analysis.Analysis.load(spark, str(tmp_path / "saved"))
    assert again.config == own.config and rows(again.tables["membership"].toPandas()) == rows(own.tables["membership"].toPandas())


def test_wide_text_of_many_genes(spark, tmp_path):
    """The plan has no expression a gene; quoted cells, missing values, blank lines, several files, and what is no matrix."""
    names = [f"g{k}" for k in range(20_000)]
    for part in range(2):
        lines = ["sample," + ",".join(names)] + [f"s{part}{r}," + ",".join(str(r + k) if k else "NA" for k in range(20_000)) for r in range(3)]
        (tmp_path / f"{part}.csv").write_text("\n".join([*lines, "", ""]))
    long = tables.read_expression(spark, str(tmp_path))
    assert len(long._jdf.queryExecution().toString()) < 5_000
    got = long.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.sum("value").alias("total")).orderBy("sample_id").collect()
    assert [tuple(r) for r in got] == [(f"s{p}{r}", 20_000, 19_999, 19_999.0 * r + 19_999 * 10_000) for p in range(2) for r in range(3)]

    def read(text, sep=","):
        path = tmp_path / f"{abs(hash(text))}.txt"
        path.write_text(text)
        return sorted(map(tuple, tables.read_expression(spark, str(path), sep).collect()), key=str)

    assert read('id;"a;b";c\n"x;1";-1e3;nan\n', ";") == [("x;1", "a;b", -1000.0), ("x;1", "c", None)]
    assert read("id,a\n") == [] and read("") == [] and read("id\nx\n") == []
    for wrong in ("id,a\nx,1,2\n", "id,a\nx,word\n", "id,a,a\nx,1,2\n"):
        with pytest.raises(Exception):  # noqa: B017 - on the driver or in a task
            read(wrong)


@pytest.mark.parametrize("zeros", [True, False])
def test_sparse_matrix(spark, zeros):
    """Against the dense matrix: an empty row, one over several blocks of positions, repeated entries, nulls and entries without a name."""
    rng = np.random.default_rng(3)
    kept = [sorted(rng.choice(70_000, n, replace=False).tolist()) for n in (5, 0, 69_000, 3)]
    cells = [(r, c, float(r + c % 7 + 1)) for r, own in enumerate(kept) for c in own] + [(3, kept[3][0], 2.0), (3, kept[3][1], None), (3, 99_999, 1.0), (3, None, 1.0)]
    starts = np.cumsum([0] + [sum(c[0] == r for c in cells) for r in range(4)]).tolist()
    indptr = spark.createDataFrame(list(enumerate(starts)), "at long, start long")
    entries = spark.createDataFrame([(at, c, v) for at, (_, c, v) in enumerate(cells)], "at long, column int, value double")
    obs = spark.createDataFrame([(r, f"s{r}", "x") for r in range(4)], "row long, sample_id string, gene_id string")
    var = spark.range(70_000).select(F.col("id").alias("column"), F.concat(F.lit("g"), "id").alias("gene_id"), F.lit(1).alias("value"))
    expr, samples, genes = tables.expression(spark, sparse=(indptr, entries, obs, var))
    if not zeros:
        expr = tables.sparse_expression(indptr, entries, obs, var, zeros=False)
    assert samples.columns == ["sample_id", "gene_id"] and genes.columns == ["gene_id", "value"]
    got = {(r[0], r[1]): r[2] for r in expr.where("value != 0 or value is null").collect()}
    want: dict = {}
    for r, c, v in cells:
        if c is not None and c < 70_000:
            key = (f"s{r}", f"g{c}")
            want[key] = None if v is None or (key in want and want[key] is None) else want.get(key, 0) + v
    assert got == want and expr.count() == (4 * 70_000 if zeros else len(want))
    empty = tables.sparse_expression(indptr, entries.limit(0), obs, var.limit(0), zeros)
    assert empty.count() == 0


def test_weighted_cleaning(spark):
    """Weights scale by gene; light, missing and infinite ones hide values, negative ones are an error; equal weights change nothing."""
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (6, 9))
    w = rng.uniform(0.2, 1, (6, 9)) * 10.0 ** np.arange(6)[:, None]
    w[1, :6], w[2, 0], w[3] = 0, np.inf, 0
    as_weights = lambda m: expr_of(spark, m).withColumnRenamed("value", "weight")
    got = {r.gene_id: r for r in clean.good_genes(expr_of(spark, x), weights=as_weights(w), min_relative_weight=0.1).collect()}
    for g in range(6):
        own = np.where(np.isfinite(w[g]), w[g], np.nan)
        own = own / (np.nanmax(own) or 1)
        seen = own >= 0.1
        r = got[f"g{g:03d}"]
        assert (r.n_present, r.n_missing) == (seen.sum(), 9 - seen.sum())
        if seen.any():
            assert r.variance == pytest.approx(np.average((x[g][seen] - np.average(x[g][seen], weights=own[seen])) ** 2, weights=own[seen]), rel=1e-6)
        assert r.good == (seen.sum() >= 5)
    kept = clean.good_samples_genes(expr_of(spark, x), weights=as_weights(w), min_relative_weight=0.1)
    assert sorted(r[0] for r in kept.select("gene_id").distinct().collect()) == ["g000", "g002", "g004", "g005"] and kept.count() == 4 * 8  # the first sample keeps three values only
    same = np.full((6, 9), 3.0)
    plain, even = clean.good_genes(expr_of(spark, x)), clean.good_genes(expr_of(spark, x), weights=as_weights(same))
    assert rows(plain.toPandas()) == rows(even.toPandas())
    assert {r.good for r in clean.good_samples(expr_of(spark, x), weights=as_weights(same)).collect()} == {True}
    with pytest.raises(Exception, match="negative"):
        clean.good_genes(expr_of(spark, x), weights=as_weights(-same)).collect()


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(SF) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
