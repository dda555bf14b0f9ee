"""Imputation, components, hub profiles and consensus merging against plain numpy."""

import numpy as np
import pytest

from loomnet.operators import components, modules


def frame(spark, x):
    cells = [(f"s{s:02d}", f"g{g:02d}", float(x[g, s])) for g in range(x.shape[0]) for s in range(x.shape[1]) if not np.isnan(x[g, s])]
    return spark.createDataFrame(cells, "sample_id string, gene_id string, value double")


def members(spark, of):
    return spark.createDataFrame([(f"g{g:02d}", m) for g, m in enumerate(of)], "gene_id string, module string")


def wide(df, names, *keys):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r.sample_id] = r.value
    return {k: np.array([v[s] for s in names]) for k, v in out.items()}


def data(seed=2, genes=30, samples=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3, samples))[np.arange(genes) % 3] * rng.uniform(0.5, 2, (genes, 1)) + rng.normal(size=(genes, samples))
    return rng, x, np.where(np.arange(genes) < 18, "a", "b")


def filled(x, k):
    """Nearest rows with the wanted cell, ties by row."""
    out = x.copy()
    for g, s in zip(*np.nonzero(np.isnan(x)), strict=True):
        square = (x - x[g]) ** 2
        shared = (~np.isnan(square)).sum(1)
        d = np.where(shared > 0, np.nansum(square, 1) * x.shape[1] / np.maximum(shared, 1), np.inf)
        d[g] = np.inf
        near = [h for h in np.argsort(d, kind="stable") if d[h] < np.inf and not np.isnan(x[h, s])][:k]
        out[g, s] = x[near, s].mean() if near else np.nanmean(x[:, s])
    return out


def test_imputation(spark, monkeypatch):
    rng, x, module = data()
    x[5] = x[7]  # equal distances
    x[rng.random(x.shape) < 0.15] = np.nan
    x[2, :10], x[18:30, 10:] = np.nan, np.where(np.arange(10) < 5, np.nan, x[18:30, 10:])  # no gene of b has samples 10 to 14
    x[29] = np.nan
    x[29, 19] = 3.0
    x[20, 19] = np.nan
    monkeypatch.setattr(components, "BLOCK", 5)
    out = {(r.gene_id, r.sample_id): r.value for r in components.impute_nearest(frame(spark, x), members(spark, module), 4).collect()}
    with np.errstate(all="ignore"), pytest.warns(RuntimeWarning):
        want = np.concatenate([filled(x[module == m], 4) for m in "ab"])
    assert set(out) == {(f"g{g:02d}", f"s{s:02d}") for g, s in zip(*np.nonzero(~np.isnan(want)), strict=True)}
    assert all(v == pytest.approx(want[int(g[1:]), int(s[1:])]) for (g, s), v in out.items())


def test_three_components_against_svd(spark, monkeypatch):
    _, x, module = data(genes=40)
    monkeypatch.setattr(components, "CELLS", 40)  # several parts
    out = components.principal_components(frame(spark, x), members(spark, module), 3)
    names = [f"s{k:02d}" for k in range(20)]
    got = wide(out, names, "module", "component")
    variance = {(r.module, r.component): r.variance for r in out.collect()}
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    for m in "ab":
        own = z[module == m]
        _, d, v = np.linalg.svd(own)
        for k in range(3):
            assert min(np.abs(got[m, k + 1] - v[k]).max(), np.abs(got[m, k + 1] + v[k]).max()) < 1e-6
            assert variance[m, k + 1] == pytest.approx(d[k] ** 2) and got[m, k + 1] @ own.mean(0) >= -1e-9
    few = components.principal_components(frame(spark, x[:2]), members(spark, ["a", "a"]), 3)
    assert {r.component for r in few.collect()} == {1, 2}
    explained = {(r.module, r.component): r.explained for r in components.component_explained(frame(spark, x), members(spark, module), out).collect()}
    for (m, k), e in explained.items():
        assert e == pytest.approx(np.mean([np.corrcoef(g, got[m, k])[0, 1] ** 2 for g in x[module == m]]))


def test_hub_profiles_where_gaps_stay(spark):
    rng, x, module = data()
    x[3, 4] = x[11, 0] = np.nan  # both in a
    out = components.module_profiles(frame(spark, x), members(spark, module), neighbours=0)
    assert {(r.module, r.kind) for r in out.select("module", "kind").distinct().collect()} == {("a", "hub"), ("b", "pc")}
    names = [f"s{k:02d}" for k in range(20)]
    got = wide(out, names, "module")["a",]
    own = x[module == "a"]
    z = (own - np.nanmean(own, 1, keepdims=True)) / np.nanstd(own, 1, keepdims=True)
    cov = np.array([[np.cov(p[~np.isnan(p + q)], q[~np.isnan(p + q)])[0, 1] for q in z] for p in z])
    k = (np.abs(cov) ** 6).mean(0) ** 3
    k = k - 1 if k.max() > 1 else k
    w = k * np.sign(cov[:, np.argmax(k)]) / k.sum()
    assert np.allclose(got, np.nansum(z * w[:, None], 0) / len(own))
    none = components.module_profiles(frame(spark, x), members(spark, module), neighbours=0, hubs=False)
    assert {r.module for r in none.select("module").distinct().collect()} == {"b"}


def test_merging_on_the_consensus(spark):
    """Two sets; b is near a in both, d near c in one only, f runs against e in both."""
    rng = np.random.default_rng(7)
    genes, module = 48, np.repeat(list("abcdef"), [12, 8, 8, 8, 7, 5])
    factor = rng.normal(size=(2, 6, 30))
    factor[:, 1] = factor[:, 0] + 0.2 * rng.normal(size=(2, 30))
    factor[0, 3] = factor[0, 2]
    factor[:, 5] = -factor[:, 4]
    x = np.stack([factor[k, ["abcdef".index(m) for m in module]] + 0.3 * rng.normal(size=(genes, 30)) for k in (0, 1)])
    rows = [(k, f"t{k}s{s:02d}", f"g{g:02d}", float(x[k, g, s])) for k in (0, 1) for g in range(genes) for s in range(30)]
    expr = spark.createDataFrame(rows, "set_id int, sample_id string, gene_id string, value double")
    names = spark.createDataFrame([(f"g{g:02d}", str(m)) for g, m in enumerate(module)] + [("g99", "grey")], "gene_id string, module string")
    run = lambda **more: {r.gene_id: (r.module, r.number) for r in modules.merge_on_consensus(expr, names, 0.2, **more).collect()}
    got = run()
    assert [got[f"g{g:02d}"][0] for g in range(genes)] == ["a" if m == "b" else m for m in module] and got["g99"] == ("grey", 0)
    assert {v for v in got.values()} == {("a", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5), ("grey", 0)}
    assert {m for m, _ in run(quantile=1.0).values()} == {"a", "c", "e", "f", "grey"}  # near in one set is enough
    assert run(absolute=True, equalize="median")["g47"][0] == "e"
