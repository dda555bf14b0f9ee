"""Masked blocks, tiles, exact quantiles and the second stage of the cut, against plain versions."""

import itertools
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomnet.operators import branches, cluster, network
from loomnet.plans.runtime import materialize

sys.path.insert(0, os.path.dirname(__file__))
import tree_cut  # noqa: E402


def gappy(spark, genes=40, samples=30, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(genes, samples)) + rng.normal(size=samples) * rng.choice([-2, 0, 2], size=(genes, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3] = np.where(np.isnan(x[3]), np.nan, 2.5)  # no spread
    x[4, :20], x[5, 20:] = np.nan, np.nan  # no shared sample
    x[4, 25:] = 7.0
    cells = [(f"s{s:02d}", f"g{g:02d}", float(x[g, s])) for g in range(genes) for s in range(samples) if not np.isnan(x[g, s])]
    return spark.createDataFrame(cells, "sample_id string, gene_id string, value double"), x


def cells(df, *keys, value="r"):
    return {tuple(row[k] for k in keys): row[value] for row in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9), k


def test_masked_blocks_equal_the_join(spark, monkeypatch):
    expr, _ = gappy(spark)
    monkeypatch.setattr(network, "BLOCK", 7)  # several blocks
    same(cells(network.correlation(expr, "masked"), "i", "j"), cells(network.correlation(expr, "join"), "i", "j"))
    assert all(row.r is None for row in network.correlation(expr, "masked").where("i = 'g03' or j = 'g03'").collect())


@pytest.mark.parametrize("keys", [("sample_id",), ("sample_id", "gene_id")])
def test_weights(spark, keys):
    expr, x = gappy(spark)
    w = expr.select(*keys).distinct().withColumn("weight", (F.pmod(F.xxhash64(*keys), F.lit(5))).cast("double"))
    lost = w.withColumn("weight", F.when(F.col("sample_id") == "s03", F.lit(float("nan"))).when(F.col("sample_id") != "s04", F.col("weight")))
    for weights in (w, lost):
        a, b = (cells(network.correlation(expr, plan, weights), "i", "j") for plan in ("masked", "join"))
        same(a, b)
    given = {tuple(row[k] for k in keys): row.weight for row in lost.collect()}
    full = np.zeros(x.shape)
    for g, s in itertools.product(range(x.shape[0]), range(x.shape[1])):
        v = given.get((f"s{s:02d}", f"g{g:02d}")[: len(keys)])
        full[g, s] = 0 if v is None or np.isnan(v) or np.isnan(x[g, s]) else v
    for i, j in ((0, 1), (7, 20), (12, 30)):
        v = full[i] * full[j] if len(keys) == 2 else np.where(full[j] > 0, full[i], 0)
        p, q = np.nan_to_num(x[i]), np.nan_to_num(x[j])
        p, q = p - (v @ p) / v.sum(), q - (v @ q) / v.sum()
        assert b[f"g{i:02d}", f"g{j:02d}"] == pytest.approx((v * p) @ q / np.sqrt(((v * p) @ p) * ((v * q) @ q)), abs=1e-9)
    with pytest.raises(Exception, match="negative weights"):
        network.correlation(expr, "masked", w.withColumn("weight", F.lit(-1.0))).collect()


def test_selected_genes(spark, monkeypatch):
    expr, _ = gappy(spark)
    monkeypatch.setattr(network, "BLOCK", 7)
    some = spark.createDataFrame([(f"g{k:02d}",) for k in (2, 9, 10, 33)], "gene_id string")
    every = cells(network.correlation(expr, "join"), "i", "j")
    want = {(i, j): r for (a, b), r in every.items() for i, j in ((a, b), (b, a)) if int(j[1:]) in (2, 9, 10, 33)}
    for plan in ("masked", "join"):
        same(cells(network.correlation(expr, plan, select=some), "i", "j"), want)
    with pytest.raises(ValueError):
        network.correlation(expr, "block", select=some)


def test_tiles_equal_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((50, 50)) * (rng.random((50, 50)) < 0.2), 1)
    a[:, 20:30] = a[20:30] = 0  # tiles without cells, genes without neighbours
    adj = spark.createDataFrame([(f"g{i:02d}", f"g{j:02d}", float(a[i, j])) for i in range(50) for j in range(i + 1, 50)], "i string, j string, a double")
    place = network.places(adj.select(F.explode(F.array("i", "j")).alias("id")), "id")
    both = network.mirrored(adj).where("a <> 0")
    numbers = both.join(place.select(F.col("id").alias("gene_id"), F.col("__at").alias("row")), "gene_id").join(place.select(F.col("id").alias("other"), F.col("__at").alias("col")), "other").withColumnRenamed("a", "value")
    full = a + a.T
    want = {(f"g{i:02d}", f"g{j:02d}"): v for (i, j), v in np.ndenumerate(full @ full) if i < j and v}
    monkeypatch.setattr(network, "STRIP", 4)
    for tile, run in ((8, 2), (64, 8)):
        same(cells(network.tile_products(numbers, place, 50, tile, run), "i", "j", value="dot"), want)
    same(cells(network.tom(adj, plan="tile"), "i", "j", value="t"), cells(network.tom(adj, plan="join"), "i", "j", value="t"))


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    for v in (rng.normal(size=3001), np.repeat([1.0, 2.0, 5.0], [10, 3, 1]), np.exp(rng.normal(size=500) * 20), np.array([4.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
        for q in (0.77,):
            assert cluster.quantile(df, "x", q, bins=16, few=3) == df.agg(F.percentile("x", F.lit(q))).first()[0], (len(v), q)
    assert cluster.quantile(df.where("false"), "x", 0.5) is None


# --- the second stage: a tree by hand, all options against plain Python --------------------------


def by_hand():
    """Clusters 1 (a), 2 (b) and 3 (c) of four; a small branch s and an item t beside a and b, an item u beside c, an item v above all, w in no merge."""
    merges, n = [], itertools.count()

    def join(left, right):
        node = f"n{next(n)}"
        merges.append((left, right, node))
        return node

    def chain(names):
        node = names[0]
        for x in names[1:]:
            node = join(node, x)
        return node

    a, b, c, s = (chain([f"{k}{i}" for i in range(size)]) for k, size in (("a", 4), ("b", 4), ("c", 4), ("s", 2)))
    ab = join(a, b)
    abs_ = join(ab, s)
    abst = join(abs_, "t")
    cu = join(c, "u")
    top = join(join(abst, cu), "v")
    size = {}
    for left, right, node in merges:
        size[node] = size.get(left, 1) + size.get(right, 1)
    below = {"s0": "ab", "s1": "ab", "t": "ab", "u": "c", "v": "abc", "w": ""}
    at = {"s0": abs_, "s1": abs_, "t": abst, "u": cu, "v": top, "w": None}
    return merges, size, below, at, s


@pytest.mark.parametrize("respect_tree, medoids, whole_small", list(itertools.product([True, False], repeat=3)))
def test_second_stage(spark, respect_tree, medoids, whole_small):
    merges, size, below, at, s = by_hand()
    names = [f"{k}{i}" for k in "abc" for i in range(4)] + list(below)
    number = {m: "abc".index(m[0]) + 1 if m[0] in "abc" else 0 for m in names}
    dendro = materialize(spark.createDataFrame([(x, y, z, 1.0, size[z]) for x, y, z in merges], "left string, right string, node string, height double, size long"), "tree")
    stage = spark.createDataFrame([(m, s if m in ("s0", "s1") else m, at.get(m), m in ("s0", "s1"), number[m]) for m in names], "id string, branch string, node string, small boolean, number int")
    for seed, limit in ((0, 0.0), (1, 0.4)):
        rng = np.random.default_rng(seed)
        d = {frozenset(p): float(rng.random()) for p in itertools.combinations(names, 2)}
        dist = lambda x, y: d[frozenset((x, y))]  # noqa: B023, E731
        pairs = spark.createDataFrame([(*sorted(p), v) for p, v in d.items()], "i string, j string, d double")
        members = {k: [m for m in names if number[m] == k] for k in (1, 2, 3)}
        central = lambda ms: min(ms, key=lambda x: (sum(dist(x, y) for y in ms if y != x), x))  # noqa: B023, E731
        if medoids:
            middle = {k: central(ms) for k, ms in members.items()}
            reach = {k: max(dist(middle[k], y) for y in ms if y != middle[k]) for k, ms in members.items()}
        else:
            reach = {k: max(np.mean([dist(x, y) for y in ms if y != x]) for x in ms) for k, ms in members.items()}
        want = {}
        for unit in ([["s0", "s1"]] if whole_small else [["s0"], ["s1"]]) + [["t"], ["u"], ["v"], ["w"]]:
            allowed = ["abc".index(k) + 1 for k in below[unit[0]]] if respect_tree else [1, 2, 3]
            far = [(dist(central(unit), middle[k]) if medoids else np.mean([dist(x, y) for x in unit for y in members[k]]), k) for k in allowed]
            if far and (min(far)[0] < reach[min(far)[1]] or min(far)[0] < limit):
                want |= dict.fromkeys(unit, min(far)[1])
        got = branches.assign_left_over(stage, dendro, pairs, respect_tree, medoids, whole_small, limit)
        assert {r.id: r.given for r in got.collect()} == want


def test_options_of_the_first_stage(spark):
    """Joining order, core sums, and what the limits of scatter, gap and split do to three tight groups of five and a loose one."""
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [4, 0], [0, 30], [60, 60]])
    x = np.concatenate([c + rng.normal(size=(5, 2)) * s for c, s in zip(centres, (0.5, 0.5, 0.5, 12), strict=True)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names = [f"g{k:02d}" for k in range(20)]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(20) for j in range(i + 1, 20)], "i string, j string, d double")
    items = spark.createDataFrame([(n,) for n in names], "id string")
    tree = materialize(cluster.linkage(pairs, items), "tree")
    cut = lambda **more: branches.hybrid_cut(tree, items, pairs, 4, 2, pam=False, **more)
    number = lambda df: np.array([n for _, n in sorted((r.id, r.number) for r in df.collect())])
    tight = number(cut(max_scatter=0.1, min_gap=0.02))
    assert tight.tolist() == [1] * 5 + [2] * 5 + [3] * 5 + [0] * 5
    assert tree_cut.agreement(number(cut(max_scatter=0.6, min_gap=0.02)), np.repeat([1, 2, 3, 4], 5)) == 1
    joined = number(cut(max_scatter=0.1, min_gap=0.02, min_split=0.2))  # the first two meet too low
    assert len(set(joined[:10])) == 1 and joined[10] != joined[0]
    assert set(number(cut(min_gap=5.0))) == {0} and set(number(cut(cut_height=0.0))) == {0}
    path, ranks = branches.joining_order(tree, items)
    placed = {}
    for r in ranks.collect():
        placed.setdefault(r.path, {})[r.rank] = r.item
    whole = placed[tree.orderBy(F.desc("height")).first().node]
    assert sorted(whole) == list(range(20)) and sorted(whole.values()) == names
    sums = {(r.path, r.k): r.total for r in branches.core_sums(ranks, pairs, 6).collect()}
    for (p, k), total in sums.items():
        first = [names.index(placed[p][r]) for r in range(k)]
        assert total == pytest.approx(d[np.ix_(first, first)].sum() / 2)
    assert max(k for _, k in sums) == 6
    assert branches.hybrid_cut(tree.where("false"), items, pairs).where("number = 0").count() == 20


def test_spanning_tree(spark):
    """The same heights and cuts as single linkage, and few rounds on a chain that single linkage climbs step by step."""
    rng = np.random.default_rng(6)
    n = 40
    pairs = spark.createDataFrame([(f"g{i:02d}", f"g{j:02d}", float(round(rng.random(), 2))) for i in range(n) for j in range(i + 1, n)], "i string, j string, d double")
    items = spark.createDataFrame([(f"g{k:02d}",) for k in range(n)], "id string")
    heights = lambda tree: sorted(r.height for r in tree.select("height").collect())
    tree = materialize(cluster.spanning_tree(pairs, items), "tree")
    assert tree.count() == n - 1 and sorted(r.d for r in tree.collect()) == heights(cluster.linkage(pairs, items, "single"))
    label = lambda e: sorted(map(tuple, cluster.cut_single(e, items, 0.05).collect()))
    assert label(tree) == label(pairs)
    assert heights(cluster.single_linkage(pairs, items)) == sorted(r.d for r in tree.collect())
    chain = spark.range(199).select(F.format_string("c%04d", "id").alias("i"), F.format_string("c%04d", F.col("id") + 1).alias("j"), (1 + F.col("id") / 2000).alias("d"))
    far = spark.range(198).select(F.format_string("c%04d", "id").alias("i"), F.format_string("c%04d", F.col("id") + 2).alias("j"), (5 + F.col("id") / 2000).alias("d"))
    long = cluster.spanning_tree(chain.union(far), spark.range(200).select(F.format_string("c%04d", "id").alias("id"))).toPandas()
    assert len(long) == 199 and long.d.max() < 2 and long["round"].max() <= 8
    assert cluster.spanning_tree(pairs.where("false"), items).count() == 0
