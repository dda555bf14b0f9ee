"""Networks: correlation, adjacency, soft threshold, topological overlap, connectivity.

All-pairs products have three plans. The relational one joins on the shared key; the block plan packs each row as a vector, cuts rows into blocks and
multiplies every pair of blocks in a task of its own (with gaps or weights, by six products of masked blocks); the tile plan, for rows as wide as there are
rows, cuts columns too and sums partial products. None puts the matrix, or a band of it, into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.functions.stats import pearson, similarity, soft_threshold
from loomnet.plans.runtime import materialize

#: Genes from which the block plan is used, rows of a block, and cells of a block of wide rows.
BLOCK_FROM, BLOCK, CELLS = 1000, 512, 4_000_000
#: Blocks up to which blocks of more rows are cut, the most rows that they get, and pairs that a task multiplies at once.
BLOCKS, LARGE, PAIRS = 16, 4096, 262_144
#: Rows and columns of a tile, tiles that one task multiplies in a row, rows of a strip of a partial sum, and rows from which the tile plan is used.
TILE, RUN, STRIP, TILE_FROM = 1024, 8, 64, 4096


def zscores(expr: DataFrame) -> DataFrame:
    """expr with value standardised by gene (population deviation); null where a gene has no spread."""
    by = W.partitionBy("gene_id")
    sd = F.stddev_pop("value").over(by)
    return expr.withColumn("value", (F.col("value") - F.avg("value").over(by)) / F.when(sd > 0, sd))


def min_max(expr: DataFrame) -> DataFrame:
    by = W.partitionBy("gene_id")
    low, high = F.min("value").over(by), F.max("value").over(by)
    return expr.withColumn("value", (F.col("value") - low) / F.when(high > low, high - low))


def places(long: DataFrame, column: str) -> DataFrame:
    """(column, __at): each value's place, from 0, in sorted order; a row a column of the matrix."""
    return long.select(column).distinct().withColumn("__at", F.row_number().over(W.orderBy(column)) - 1)


def packed(long: DataFrame, row: str, column: str, value: str = "value", place: DataFrame | None = None, weight: str | None = None) -> tuple[DataFrame, int]:
    """(id, at, v), a row's cells as places among the sorted columns and values, and how many columns there are. Null cells are left out. With ``weight`` also w."""
    place = places(long, column) if place is None else place
    cells = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("__at", value, *([weight] if weight else []))))
    rows = long.join(place, column).groupBy(row).agg(F.sort_array(cells).alias("c"))  # in one order, so that places take no room in a compressed shuffle
    return rows.select(F.col(row).alias("id"), F.col("c.__at").alias("at"), F.col(f"c.{value}").alias("v"), *([F.col(f"c.{weight}").alias("w")] if weight else [])), place.count()


def dense(batch, width: int, absent: float = 0.0, column: str = "v") -> np.ndarray:
    """The matrix of packed rows, ``absent`` where a cell is missing."""
    at, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch["at"], batch[column]))
    out = np.full((len(at), width), absent)
    rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
    out[rows, at.flatten().to_numpy(zero_copy_only=False)] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def block_rows(width: int, rows: int = 0) -> int:
    """Rows of a block: so many that its cells stay within bounds, and more where there are many rows, as each is sent once for every block."""
    return min(max(BLOCK, min(LARGE, rows // BLOCKS)), max(16, CELLS // max(1, width)))


def _in_pairs(rows: DataFrame, width: int, counts: tuple[int, ...], others: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Packed rows with ``a`` and ``b``, the pair of blocks that a copy is for, and ``right``, whether it stands on the right in it. Pairs are those of blocks of the rows themselves (all within one
    value of ``by``, if given), a row of a <= b; or of every block of ``rows`` with every one of ``others``. ``counts``: rows of either side."""
    blocks = [max(1, -(-n // block_rows(width, max(counts)))) for n in counts]
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = [by] if by else []
    if others is not None:
        left = rows.select("*", F.lit(False).alias("right"), part(F.lit(blocks[0])).alias("a"), every(F.lit(blocks[1])).alias("b"))
        right = others.select("*", F.lit(True).alias("right"), every(F.lit(blocks[0])).alias("a"), part(F.lit(blocks[1])).alias("b"))
        return left.unionByName(right).repartition(min(1000, blocks[0] * blocks[1]), "a", "b")
    n, tasks = F.lit(blocks[0]), blocks[0] * (blocks[0] + 1) // 2
    if by:
        step = block_rows(width, max(counts))
        rows = rows.join(rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / step).cast("int").alias("__blocks")), by)  # a row a module
        n, tasks = F.col("__blocks"), tasks + 100
    cut = rows.withColumn("__mine", part(n)).withColumn("__other", every(n))
    a, b = F.least("__mine", "__other"), F.greatest("__mine", "__other")
    return cut.select("*", (F.col("__mine") > F.col("__other")).alias("right"), a.alias("a"), b.alias("b")).drop("__mine", "__other", "__blocks").repartition(min(1000, tasks), *keys, "a", "b")


def _on_pairs(dealt: DataFrame, keys: list[str], matrix: Callable, work: Callable, schema: str) -> DataFrame:
    """What ``work`` yields from each pair of blocks: it gets the two sides, each a table sorted by id and its matrix, and None for the right side of a block with itself."""

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pc.sort_indices(table["id"])).combine_chunks()
        sides = [table.filter(pc.equal(table["right"], side)) for side in (False, True)]
        yield from work(*[(side, matrix(side)) if side.num_rows else None for side in sides])

    return dealt.groupBy(*keys, "a", "b").applyInArrow(task, schema)


def _strips(x: np.ndarray, y: np.ndarray, product: Callable) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, products) of some rows of x after the other with all of y."""
    step = max(1, PAIRS // max(1, y.shape[-2]))
    for at in range(0, x.shape[-2], step):
        yield at, product(x[..., at : at + step, :], y)


def _spelt(i: pa.Array, j: pa.Array, dot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([i, j, pa.array(dot)], names=["i", "j", "dot"])


def block_products(vectors: DataFrame, width: int, rows: int, product=lambda x, y: x @ y.T, absent: float = 0.0, matrix=None) -> DataFrame:
    """(i, j, dot) of all pairs i < j of packed rows, by products of blocks (or by what else ``product`` makes of two matrices).

    ``matrix`` turns a table of packed rows into its matrix, or a stack of them, rows last but one. A task hands its pairs back strip by strip, so it never holds those of a whole pair of blocks."""
    matrix = matrix or (lambda table: dense(table, width, absent))

    def work(left, right):
        same, (table, x) = left is None or right is None, left or right
        (other, y) = (table, x) if same else right
        mine, theirs = (t["id"].combine_chunks() for t in (table, other))
        names = np.array(theirs.to_pylist(), object)
        first = np.arange(1, len(names) + 1) if same else np.searchsorted(names, np.array(mine.to_pylist(), object))  # from where on the other name is the larger one
        for at, dots in _strips(x, y, product):
            larger = np.arange(len(names)) >= first[at : at + len(dots), None]
            p, q = np.nonzero(larger)
            yield _spelt(mine.take(pa.array(p + at)), theirs.take(pa.array(q)), dots[p, q])
            if not same:
                q, p = np.nonzero(~larger.T)
                yield _spelt(theirs.take(pa.array(q)), mine.take(pa.array(p + at)), dots[p, q])

    return _on_pairs(_in_pairs(vectors, width, (rows,)), [], matrix, work, "i string, j string, dot double")


def block_sums(vectors: DataFrame, width: int, rows: int, product, matrix, terms: Callable, by: str | None = None, diagonal: bool = False) -> DataFrame:
    """(id, sums), and ``by`` if given: for every packed row the sums of some terms over all other rows (of the same ``by``), by products of blocks.

    ``terms`` gets a strip of products and the tables of its rows and columns and yields matrices to be summed; NaN counts as nothing. Pairs never leave a task. With ``diagonal`` a row meets itself too."""

    def work(left, right):
        same, (table, x) = left is None or right is None, left or right
        (other, y) = (table, x) if same else right
        own, theirs = [], []
        for at, dots in _strips(x, y, product):
            here = table.slice(at, len(dots))
            for k, term in enumerate(terms(dots, here, other)):
                if same and not diagonal:
                    term[np.arange(len(dots)), np.arange(at, at + len(dots))] = 0
                if k == len(own):
                    own.append(np.zeros(table.num_rows))
                    theirs.append(np.zeros(other.num_rows))
                own[k][at : at + len(dots)] = np.nansum(term, 1)
                if not same:
                    theirs[k] += np.nansum(term, 0)
        for t, sums in ((table, own), (other, theirs)) if not same else ((table, own),):
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (t.num_rows + 1) * len(sums), len(sums)), pa.int32()), pa.array(np.column_stack(sums).ravel()))
            keys = [t[by].combine_chunks()] if by else []
            yield pa.RecordBatch.from_arrays([*keys, t["id"].combine_chunks(), listed], names=[*([by] if by else []), "id", "sums"])

    keys = [by] if by else []
    parts = _on_pairs(_in_pairs(vectors, width, (rows,), by=by), keys, matrix, work, ", ".join([*(f"{k} string" for k in keys), "id string", "sums array<double>"]))
    return parts.select(*keys, "id", F.posexplode("sums").alias("k", "s")).groupBy(*keys, "id", "k").agg(F.sum("s").alias("s")).groupBy(*keys, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums"))


def column_products(vectors: DataFrame, others: DataFrame, width: int, rows: int, other_rows: int, product, matrix) -> DataFrame:
    """(i, j, dot) of every packed row with every one of ``others`` but itself, by products of blocks of either side."""

    def work(left, right):
        if left is None or right is None:
            return
        (table, x), (other, y) = left, right
        mine, theirs = (t["id"].combine_chunks() for t in (table, other))
        for at, dots in _strips(x, y, product):
            p, q = (m.ravel() for m in np.indices(dots.shape))
            yield _spelt(mine.take(pa.array(p + at)), theirs.take(pa.array(q)), dots.ravel())

    return _on_pairs(_in_pairs(vectors, width, (rows, other_rows), others), [], matrix, work, "i string, j string, dot double").where("i <> j")


def tile_products(cells: DataFrame, names: DataFrame, size: int, tile: int = TILE, run: int = RUN) -> DataFrame:
    """(i, j, dot), i < j, of all pairs of rows of a square matrix whose products are not zero, from its cells (row, col, value) that are not zero.

    ``names`` is (id, __at), the names by row number in sorted order. Rows and columns are cut into tiles of ``tile`` by ``tile`` cells. A task multiplies ``run`` pairs of
    tiles (a, k) and (b, k) at most and leaves its partial sum in strips of rows, which are added up. Tiles without cells are not there and so are never sent. A row goes to as
    many tasks as there are tiles in a row, not to as many as narrow blocks of whole rows would be."""
    blocks = max(1, -(-size // tile))
    part = lambda c: F.floor(F.col(c) / tile).cast("int")
    placed = cells.select(part("row").alias("a"), part("col").alias("k"), F.pmod("row", F.lit(tile)).cast("int").alias("r"), F.pmod("col", F.lit(tile)).cast("int").alias("c"), "value")

    def pack(key, table):
        r, c, v = (table[x].to_numpy().astype(t) for x, t in (("r", "<u2"), ("c", "<u2"), ("value", "<f8")))
        return pa.table({"a": [key[0].as_py()], "k": [key[1].as_py()], "n": [len(v)], "cells": pa.array([v.tobytes() + r.tobytes() + c.tobytes()], pa.binary())}, schema=pa.schema({"a": pa.int32(), "k": pa.int32(), "n": pa.int32(), "cells": pa.binary()}))

    def full(n: int, raw: bytes) -> np.ndarray:
        out = np.zeros((tile, tile))
        r, c = (np.frombuffer(raw, "<u2", n, 8 * n + d * n) for d in (0, 2))
        out[r, c] = np.frombuffer(raw, "<f8", n)
        return out

    def multiply(key, left, right):
        listed = lambda table, *names: zip(*(table[c].to_pylist() for c in names), strict=True) if table.num_rows else ()
        mine, total = {k: (n, raw) for k, n, raw in listed(left, "k", "n", "cells")}, None
        for k, n, raw in listed(right, "ko", "no", "others"):
            if k in mine:
                dots = full(*mine[k]) @ full(n, raw).T
                total = dots if total is None else total + dots
        strips = [] if total is None else [s for s in range(0, tile, STRIP) if total[s : s + STRIP].any()]
        a, b = (np.full(len(strips), k.as_py(), np.int32) for k in key[:2])
        return pa.table({"a": a, "b": b, "s": pa.array(strips, pa.int32()), "dots": pa.array([total[s : s + STRIP].tobytes() for s in strips], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x, np.float64) for x in table["dots"].to_pylist())
        schema = pa.schema({"a": pa.int32(), "b": pa.int32(), "s": pa.int32(), "dots": pa.binary()})
        return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], "s": [key[2].as_py()], "dots": pa.array([total.tobytes()], pa.binary())}, schema=schema)

    def spell(batches):
        for batch in batches:
            for a, b, s, dots, mine, other in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s", "dots", "mine", "other")), strict=True):
                dots = np.frombuffer(dots, np.float64).reshape(-1, tile)
                i, j = np.nonzero(dots)
                i = i + s
                keep = i < j if a == b else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                mine, other = pa.array(mine, pa.string()), pa.array(other, pa.string())
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(i)), other.take(pa.array(j)), pa.array(dots[i - s, j])], names=["i", "j", "dot"])

    tiles = materialize(placed.groupBy("a", "k").applyInArrow(pack, "a int, k int, n int, cells binary"), "tiles")
    group = F.floor(F.col("k") / run).cast("int").alias("g")
    left = tiles.select("a", F.explode(F.sequence(F.col("a"), F.lit(blocks - 1))).alias("b"), group, "k", "n", "cells").groupBy("a", "b", "g")
    right = tiles.select(F.explode(F.sequence(F.lit(0), F.col("a"))).alias("a"), F.col("a").alias("b"), group, F.col("k").alias("ko"), F.col("n").alias("no"), F.col("cells").alias("others")).groupBy("a", "b", "g")
    parts = left.cogroup(right).applyInArrow(multiply, "a int, b int, s int, dots binary")
    sums = parts.groupBy("a", "b", "s").applyInArrow(add, "a int, b int, s int, dots binary")
    spelt = names.groupBy(part("__at").alias("a")).agg(F.sort_array(F.collect_list(F.struct("__at", "id")))["id"].alias("mine"))  # ``tile`` names at most
    rows = sums.join(spelt, "a").join(spelt.select(F.col("a").alias("b"), F.col("mine").alias("other")), "b")
    return rows.mapInArrow(spell, "i string, j string, dot double")


def weighted(expr: DataFrame, weights: DataFrame | None) -> DataFrame:
    """expr with a column weight, for pairs of observations to multiply: 1 without weights; the weight of the observation if ``weights`` has gene_id; of the sample
    (its root, so that the product is the weight) if not. Observations without a finite weight above 0 are left out; negative weights are an error."""
    if weights is None:
        return expr.withColumn("weight", F.lit(1.0))
    w = F.col("weight").cast("double")
    fine = F.when(w < 0, F.raise_error(F.lit("negative weights"))).otherwise(w)
    keys = [c for c in ("sample_id", "gene_id") if c in weights.columns]
    usable = weights.where(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf"))).select(*keys, (fine if "gene_id" in keys else F.sqrt(fine)).alias("weight"))
    return expr.join(usable.where("weight <> 0"), keys)


def _stack(table, width: int) -> np.ndarray:
    """Weights, weighted values and weighted squares of packed rows; 0 where a cell is missing."""
    w, x = dense(table, width, column="w"), dense(table, width)
    return np.stack([w, w * x, w * x * x])


def _masked_pearson(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlations over shared cells by six products; NaN without spread, infinite where no cell is shared."""
    n, sx, sy, sxx, syy, sxy = (p[a] @ q[b].T for a, b in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)))
    a, b = n * sxx - sx * sx, n * syy - sy * sy
    flat = (a <= 1e-12 * n * sxx) | (b <= 1e-12 * n * syy)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip((n * sxy - sx * sy) / np.sqrt(a * b), -1, 1)
    return np.where(n > 0, np.where(flat, np.nan, r), np.inf)


def _plan(expr: DataFrame, plain: bool = True) -> str:
    """'join' for few genes, else 'block' for complete data without weights or selected genes (``plain``), else 'masked'."""
    genes = expr.agg(F.countDistinct("gene_id"), F.countDistinct("sample_id"), F.count("value")).first()
    return "join" if genes[0] < BLOCK_FROM else "block" if plain and genes[0] * genes[1] == genes[2] else "masked"


def _standard(table, width: int) -> np.ndarray:
    """Standardised values of packed rows; NaN in rows without a cell, which have no spread."""
    x = dense(table, width)
    x[pc.equal(pc.list_value_length(table["at"]), 0).to_numpy()] = np.nan
    return x


def _vectors(expr: DataFrame, plan: str, weights: DataFrame | None = None, keep: DataFrame | None = None) -> tuple[DataFrame, int, int, Callable, Callable]:
    """Genes as packed rows for the plan 'block' or 'masked', written once, with the number of samples and of genes, what makes a matrix of rows, and correlations of two such.
    ``keep`` is (gene_id, module): then only these genes, with their module."""
    if plan == "block":
        long, weight = zscores(expr), None
    else:
        by = W.partitionBy("gene_id")
        spread = F.stddev_pop("value").over(by)
        centred = (F.col("value") - F.avg("value").over(by)) / F.when(spread > 0, spread).otherwise(1.0)
        long, weight = weighted(expr.withColumn("value", centred), weights), "weight"
    rows, width = packed(long, "gene_id", "sample_id", place=materialize(places(long, "sample_id"), "samples"), weight=weight)
    if keep is not None:
        rows = rows.join(keep.select(F.col("gene_id").alias("id"), "module"), "id")
    rows = materialize(rows, "vectors")
    if plan == "block":
        return rows, width, rows.count(), lambda table: _standard(table, width), lambda x, y: np.clip(x @ y.T / width, -1, 1)
    return rows, width, rows.count(), lambda table: _stack(table, width), _masked_pearson


def correlation(expr: DataFrame, plan: str = "auto", weights: DataFrame | None = None, select: DataFrame | None = None) -> DataFrame:
    """(i, j, r), i < j: Pearson over shared samples of every pair of genes; null without spread, and pairs without a shared sample are left out.

    ``weights`` is (sample_id, weight) or (sample_id, gene_id, weight): a pair's weight in a sample is the sample's, or the product of its two observations'.
    ``select`` (gene_id) asks for some genes only: then every gene i goes with every selected gene j but itself, in that order.
    Plans: 'join'; 'block' for complete data without weights; 'masked', blocks with gaps or weights. 'auto' counts."""
    if plan == "auto":
        plan = _plan(expr, weights is None and select is None)
    if plan == "block" and (weights is not None or select is not None):
        raise ValueError("the plan 'block' takes neither weights nor selected genes")
    if plan in ("block", "masked"):
        rows, width, genes, matrix, product = _vectors(expr, plan, weights)
        if select is None:
            pairs = block_products(rows, width, genes, product, matrix=matrix)
        else:
            some = rows.join(select.select(F.col("gene_id").alias("id")).distinct(), "id", "left_semi")
            pairs = column_products(rows, some, width, genes, some.count(), product, matrix)
        return pairs.where(F.isnan("dot") | (F.col("dot") <= 1)).select("i", "j", F.when(~F.isnan("dot"), F.col("dot")).alias("r"))  # in Spark's order NaN is the largest
    own = weighted(zscores(expr), weights)
    a = own.select(F.col("gene_id").alias("i"), "sample_id", F.col("value").alias("x"), F.col("weight").alias("v"))
    b = own if select is None else own.join(select.select("gene_id").distinct(), "gene_id", "left_semi")
    b = b.select(F.col("gene_id").alias("j"), "sample_id", F.col("value").alias("y"), F.col("weight").alias("w"))
    r = pearson(F.col("x"), F.col("y")) if weights is None else pearson(F.col("x"), F.col("y"), F.col("v") * F.col("w"))
    return a.join(b, "sample_id").where("i < j" if select is None else "i <> j").groupBy("i", "j").agg(r.alias("r"))


def _similar(r: np.ndarray, network_type: str) -> np.ndarray:
    """similarity() on a matrix of correlations; NaN for pairs without one."""
    r = np.where(np.isinf(r), np.nan, r)
    return {"unsigned": np.abs, "signed": lambda r: (1 + r) / 2, "signed hybrid": lambda r: np.maximum(r, 0)}[network_type](r)


def _raised(s: np.ndarray, powers) -> Iterator[np.ndarray]:
    """s to each of the powers; from a whole one to the next whole one by multiplication."""
    at, last = 1, s
    for power in powers:
        if power != int(power) or power < at:
            yield s**power
            continue
        while at < power:
            last, at = last * s, at + 1
        yield last.copy()


def adjacency(pairs: DataFrame, network_type: str = "signed hybrid", power: float = 6) -> DataFrame:
    """(i, j, a), i < j, from (i, j, r); the diagonal is 1 and not stored."""
    return pairs.select("i", "j", soft_threshold(similarity(F.col("r"), network_type), power).alias("a"))


def mirrored(pairs: DataFrame, value: str = "a") -> DataFrame:
    """(gene_id, other, value) for both directions, without a second pass over the pairs."""
    both = F.explode(F.array(F.struct(F.col("i").alias("gene_id"), F.col("j").alias("other")), F.struct(F.col("j").alias("gene_id"), F.col("i").alias("other"))))
    return pairs.select(both.alias("p"), value).select("p.gene_id", "p.other", value)


def connectivity(adj: DataFrame) -> DataFrame:
    """gene_id, k: the sum of adjacencies to all others."""
    return mirrored(adj).groupBy("gene_id").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("k"))


def soft_connectivity(expr: DataFrame, network_type: str = "signed", power: float = 15, min_samples: int = 4) -> DataFrame:
    """gene_id, k; null for genes with fewer than ``min_samples`` values."""
    k = connectivity_by_power(expr, (power,), network_type).select("gene_id", "k")
    present = expr.groupBy("gene_id").agg(F.count("value").alias("n"))
    return present.join(k, "gene_id", "left").select("gene_id", F.when(F.col("n") >= min_samples, F.coalesce("k", F.lit(0.0))).alias("k"))


def power_connectivity(pairs: DataFrame, powers, network_type: str = "signed hybrid") -> DataFrame:
    """(power, gene_id, k) for all powers in one aggregation: a sum per power, and rows only afterwards."""
    s = mirrored(pairs.select("i", "j", similarity(F.col("r"), network_type).alias("s")), "s")
    wide = s.groupBy("gene_id").agg(*[F.sum(soft_threshold(F.col("s"), p)).alias(f"p{n}") for n, p in enumerate(powers)])
    each = F.explode(F.array(*[F.struct(F.lit(int(p) if p == int(p) else p).alias("power"), F.coalesce(F.col(f"p{n}"), F.lit(0.0)).alias("k")) for n, p in enumerate(powers)]))
    return wide.select("gene_id", each.alias("e")).select("e.power", "gene_id", "e.k")


def connectivity_by_power(expr: DataFrame, powers, network_type: str = "signed hybrid") -> DataFrame:
    """(power, gene_id, k): power_connectivity() of the correlations of expr. From BLOCK_FROM genes on tasks add up the pairs of their blocks, so no pair is ever written or sent."""
    powers, plan = tuple(powers), _plan(expr)
    if plan == "join":
        return power_connectivity(correlation(expr, plan), powers, network_type)
    rows, width, genes, matrix, product = _vectors(expr, plan)

    def terms(r, *_):
        yield (~np.isinf(r)).astype(float)
        yield from _raised(_similar(r, network_type), powers)

    sums = block_sums(rows, width, genes, product, matrix, terms).where(F.col("sums")[0] > 0)  # genes without a pair have no connectivity
    each = F.explode(F.array(*[F.struct(F.lit(int(p) if p == int(p) else p).alias("power"), F.col("sums")[n + 1].alias("k")) for n, p in enumerate(powers)]))
    return sums.select(F.col("id").alias("gene_id"), each.alias("e")).select("e.power", "gene_id", "e.k")


def scale_free_fit(k: DataFrame, breaks: int = 10) -> DataFrame:
    """power, r_sq, slope, truncated_r_sq: log10 frequency against log10 mean k over equal-width bins, closed on the right; an empty bin
    counts with its middle and frequency 0. The truncated fit has the mean itself as a second predictor and is adjusted."""
    span = k.groupBy("power").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / breaks)
    bin_ = F.greatest(F.lit(1), F.least(F.lit(breaks), F.ceil((F.col("k") - F.col("low")) / width).cast("int")))
    binned = k.join(F.broadcast(span), "power").groupBy("power", F.coalesce(bin_, F.lit(1)).alias("bin")).agg(F.avg("k").alias("mean"), F.count(F.lit(1)).alias("count"))  # a row a power
    grid = span.select("power", "low", "high", "n", F.explode(F.sequence(F.lit(1), F.lit(breaks))).alias("bin"))
    middle = F.col("low") + (F.col("bin") - 0.5) * (F.col("high") - F.col("low")) / breaks
    full = grid.join(binned, ["power", "bin"], "left").select("power", F.coalesce("mean", middle).alias("dk"), (F.coalesce("count", F.lit(0)) / F.col("n")).alias("p"))
    points = full.select("power", "dk", F.log10(F.when(F.col("dk") > 0, F.col("dk"))).alias("x"), F.log10(F.col("p") + 1e-9).alias("y"))
    r1, r2, r12 = pearson(F.col("y"), F.col("x")), pearson(F.col("y"), F.col("dk")), pearson(F.col("x"), F.col("dk"))
    fit = points.groupBy("power").agg(r1.alias("r1"), r2.alias("r2"), r12.alias("r12"), F.regr_slope("y", "x").alias("slope"), F.count("x").alias("m"))
    both = (F.pow("r1", F.lit(2)) + F.pow("r2", F.lit(2)) - 2 * F.col("r1") * F.col("r2") * F.col("r12")) / F.when(F.abs("r12") < 1, 1 - F.pow("r12", F.lit(2)))
    return fit.select("power", F.pow("r1", F.lit(2)).alias("r_sq"), "slope", (1 - (1 - both) * (F.col("m") - 1) / (F.col("m") - 3)).alias("truncated_r_sq"))


def soft_threshold_table(k: DataFrame, breaks: int = 10) -> DataFrame:
    """One row a power: power, r_sq, slope, truncated_r_sq, mean_k, median_k, max_k."""
    spread = k.groupBy("power").agg(F.avg("k").alias("mean_k"), F.median("k").alias("median_k"), F.max("k").alias("max_k"))
    return scale_free_fit(k, breaks).join(spread, "power")


def pick_power(table: DataFrame, rsquared_cut: float = 0.9, mean_cut: float = 100.0) -> DataFrame:
    """One row: the least power that fits well enough with a mean connectivity small enough, else the one of best fit."""
    good = (F.col("r_sq") > rsquared_cut) & (F.col("mean_k") <= mean_cut)
    return table.agg(F.coalesce(F.min(F.when(good, F.col("power"))), F.max_by("power", F.struct(F.coalesce("r_sq", F.lit(-1.0)), -F.col("power")))).alias("power"))


def network_concepts(k: DataFrame) -> DataFrame:
    """power, density, centralization, heterogeneity."""
    n, total, top, squares = F.count(F.lit(1)), F.sum("k"), F.max("k"), F.sum(F.col("k") * F.col("k"))
    s = k.groupBy("power").agg(n.cast("double").alias("n"), total.alias("t"), top.alias("top"), squares.alias("sq"))
    return s.select(
        "power",
        (F.col("t") / (F.col("n") * (F.col("n") - 1))).alias("density"),
        (F.col("n") * (F.col("top") - F.col("t") / F.col("n")) / ((F.col("n") - 1) * (F.col("n") - 2))).alias("centralization"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("n") * F.col("sq") / F.when(F.col("t") > 0, F.col("t") * F.col("t")) - 1)).alias("heterogeneity"),
    )


def tom(adj: DataFrame, denominator: str = "min", plan: str = "auto") -> DataFrame:
    """(i, j, t), i < j: topological overlap (l + a) / (min(k_i, k_j) + 1 - a), l the sum over shared neighbours; the diagonal is 1.

    Pairs without shared neighbours are there with l = 0. From BLOCK_FROM // 4 genes on, l comes from products of blocks, and from TILE_FROM on of tiles."""
    both = mirrored(adj)
    k = both.groupBy("gene_id").agg(F.sum("a").alias("k"))
    genes = k.count() if plan == "auto" else 0
    if plan == "tile" or genes >= TILE_FROM:
        place = materialize(places(k, "gene_id"), "places")
        cells = both.where("a <> 0").join(place.select("gene_id", F.col("__at").alias("row")), "gene_id").join(place.select(F.col("gene_id").alias("other"), F.col("__at").alias("col")), "other")
        shared = tile_products(cells.select("row", "col", F.col("a").alias("value")), place.withColumnRenamed("gene_id", "id"), genes or k.count()).withColumnRenamed("dot", "l")
    elif plan == "block" or genes >= BLOCK_FROM // 4:
        shared = block_products(*packed(both.withColumnRenamed("a", "value"), "gene_id", "other"), genes or k.count()).withColumnRenamed("dot", "l")
    else:
        near = both.where("a <> 0")
        a = near.select(F.col("gene_id").alias("i"), F.col("other").alias("u"), F.col("a").alias("x"))
        b = near.select(F.col("gene_id").alias("j"), F.col("other").alias("u"), F.col("a").alias("y"))
        shared = a.join(b, "u").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("l"))
    full = adj.select("i", "j", F.coalesce("a", F.lit(0.0)).alias("a")).join(shared, ["i", "j"], "left")
    ki, kj = k.select(F.col("gene_id").alias("i"), F.col("k").alias("ki")), k.select(F.col("gene_id").alias("j"), F.col("k").alias("kj"))
    least = F.least("ki", "kj") if denominator == "min" else (F.col("ki") + F.col("kj")) / 2
    t = (F.coalesce("l", F.lit(0.0)) + F.col("a")) / (least + 1 - F.col("a"))
    return full.join(ki, "i").join(kj, "j").select("i", "j", F.abs(t).alias("t"))


def tom_among(expr: DataFrame, genes: DataFrame, network_type: str = "signed hybrid", power: float = 6, denominator: str = "min") -> DataFrame:
    """tom() of the adjacency of expr for pairs of ``genes`` (gene_id) alone: only their rows of the network are made, a row a gene of expr and chosen gene."""
    ids = genes.select("gene_id").distinct()
    rows = materialize(adjacency(correlation(expr, select=ids), network_type, power), "rows")  # every gene i with every chosen gene j
    k = rows.groupBy("j").agg(F.sum("a").alias("k"))
    x = rows.where("a <> 0").select("i", F.col("j").alias("p"), F.col("a").alias("x"))
    y = rows.where("a <> 0").select("i", F.col("j").alias("q"), F.col("a").alias("y"))
    shared = x.join(y, "i").where("p < q").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("l"))
    inside = rows.join(ids.withColumnRenamed("gene_id", "i"), "i", "left_semi").where("i < j").select(F.col("i").alias("p"), F.col("j").alias("q"), F.coalesce("a", F.lit(0.0)).alias("a"))
    full = inside.join(shared, ["p", "q"], "left").join(k.select(F.col("j").alias("p"), F.col("k").alias("kp")), "p").join(k.select(F.col("j").alias("q"), F.col("k").alias("kq")), "q")
    least = F.least("kp", "kq") if denominator == "min" else (F.col("kp") + F.col("kq")) / 2
    return full.select(F.col("p").alias("i"), F.col("q").alias("j"), F.abs((F.coalesce("l", F.lit(0.0)) + F.col("a")) / (least + 1 - F.col("a"))).alias("t"))


def dissimilarity(t: DataFrame) -> DataFrame:
    return t.select("i", "j", F.round(1 - F.col("t"), 8).alias("d"))


def intramodular(adj: DataFrame, membership: DataFrame, scale_by_max: bool = False) -> DataFrame:
    """gene_id, module, k_total, k_within (0 in modules under three genes), k_out, k_diff."""
    m = membership.select("gene_id", "module")
    other = m.select(F.col("gene_id").alias("other"), F.col("module").alias("other_module"))
    edges = mirrored(adj).join(m, "gene_id").join(other, "other")
    sums = edges.groupBy("gene_id", "module").agg(F.sum("a").alias("k_total"), F.sum(F.when(F.col("module") == F.col("other_module"), F.col("a")).otherwise(0.0)).alias("k_within"))
    return _intramodular(sums, m, scale_by_max)


def _intramodular(sums: DataFrame, m: DataFrame, scale_by_max: bool) -> DataFrame:
    """intramodular() from its sums (gene_id, module, k_total, k_within)."""
    size = m.groupBy("module").agg(F.count(F.lit(1)).alias("size"))
    sums = sums.join(size, "module").withColumn("k_within", F.when(F.col("size") < 3, 0.0).otherwise(F.col("k_within")))
    if scale_by_max:
        top = F.max("k_within").over(W.partitionBy("module"))
        sums = sums.withColumn("k_within", F.col("k_within") / F.when(top > 0, top))
    out = F.lit(0.0) if scale_by_max else F.col("k_total") - F.col("k_within")
    return sums.select("gene_id", "module", "k_total", "k_within", out.alias("k_out"), (F.col("k_within") - out).alias("k_diff"))


def intramodular_of(expr: DataFrame, membership: DataFrame, network_type: str = "signed hybrid", power: float = 6, scale_by_max: bool = False) -> DataFrame:
    """intramodular() of the adjacency of expr; a gene has one module. From BLOCK_FROM genes on no pair leaves the task that makes it."""
    plan, m = _plan(expr), membership.select("gene_id", "module")
    if plan == "join":
        return intramodular(adjacency(correlation(expr, plan), network_type, power), membership, scale_by_max)
    rows, width, genes, matrix, product = _vectors(expr, plan, keep=m)

    def terms(r, left, right):
        mine, theirs = (t["module"].to_pylist() for t in (left, right))
        code = {name: k for k, name in enumerate({*mine, *theirs})}
        mine, theirs = (np.array([code[name] for name in names]) for names in (mine, theirs))
        a = next(_raised(_similar(r, network_type), (power,)))
        yield (~np.isinf(r)).astype(float)
        yield (~np.isnan(a)).astype(float)
        yield a
        yield np.where(mine[:, None] == theirs, a, 0.0)

    pairs, known, total, within = (F.col("sums")[k] for k in range(4))
    sums = block_sums(rows, width, genes, product, matrix, terms).where(pairs > 0).withColumnRenamed("id", "gene_id").join(m, "gene_id")
    return _intramodular(sums.select("gene_id", "module", F.when(known > 0, total).alias("k_total"), within.alias("k_within")), m, scale_by_max)


def hub_genes(adj: DataFrame, membership: DataFrame, n: int = 10) -> DataFrame:
    """module, gene_id, connectivity (within the module, the gene itself counts 1) and rank of the n most connected genes of every module."""
    return _hubs(intramodular_sums(adj, membership), n)


def _hubs(within: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("module").orderBy(F.desc(F.round("connectivity", 9)), "gene_id"))
    return within.withColumn("rank", nth).where(F.col("rank") <= n)


def hub_genes_of(expr: DataFrame, membership: DataFrame, network_type: str = "signed hybrid", power: float = 6, n: int = 10) -> DataFrame:
    """hub_genes() of the adjacency of expr. From BLOCK_FROM genes on only pairs of a module are multiplied, and none leaves its task."""
    plan = _plan(expr)
    if plan == "join":
        return hub_genes(adjacency(correlation(expr, plan), network_type, power), membership, n)
    rows, width, genes, matrix, product = _vectors(expr, plan, keep=membership)
    sums = block_sums(rows, width, genes, product, matrix, lambda r, *_: _raised(_similar(r, network_type), (power,)), by="module").withColumnRenamed("id", "gene_id")
    within = membership.select("module", "gene_id").join(sums, ["module", "gene_id"], "left")
    return _hubs(within.select("module", "gene_id", (1 + F.coalesce(F.col("sums")[0], F.lit(0.0))).alias("connectivity")), n)


def intramodular_sums(adj: DataFrame, membership: DataFrame) -> DataFrame:
    m = membership.select(F.col("gene_id").alias("i"), "module")
    inside = adj.join(m, "i").join(m.select(F.col("i").alias("j"), "module"), ["j", "module"])
    both = F.explode(F.array("i", "j"))
    sums = inside.select("module", both.alias("gene_id"), "a").groupBy("module", "gene_id").agg(F.sum("a").alias("s"))
    return membership.select("module", "gene_id").join(sums, ["module", "gene_id"], "left").select("module", "gene_id", (1 + F.coalesce("s", F.lit(0.0))).alias("connectivity"))


def check_symmetric(matrix: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """One row of counts over a full (i, j, v) matrix: cells out of range, cells that differ from their mirror by more than 1e-12, missing mirrors."""
    mirror = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return matrix.join(mirror, ["i", "j"], "left").agg(
        F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("out_of_range"), F.count_if(F.abs(F.col("v") - F.col("w")) > 1e-12).alias("asymmetric"), F.count_if(F.col("w").isNull()).alias("unmatched")
    )


def checked_correlation(expr: DataFrame) -> DataFrame:
    """check_symmetric() of the full matrix of correlations of expr. From BLOCK_FROM genes on a task makes its blocks and, by products the other way round, their mirrors, and counts there."""
    plan = _plan(expr)
    if plan == "join":
        return check_symmetric(mirrored(correlation(expr, plan), "r").select(F.col("gene_id").alias("i"), F.col("other").alias("j"), F.col("r").alias("v")))
    rows, width, genes, matrix, product = _vectors(expr, plan)

    def work(left, right):
        same, (_, x) = left is None or right is None, left or right
        (_, y), counts = (left or right) if same else right, np.zeros(3, np.int64)
        for at, v in _strips(x, y, product):
            w = product(y, x[..., at : at + len(v), :]).T
            cells = ~np.isinf(v)
            if same:
                cells[np.arange(len(v)), np.arange(at, at + len(v))] = False
            for a, b, here in ((v, w, cells),) if same else ((v, w, cells), (w, v, ~np.isinf(w))):
                lost = np.isinf(b) | np.isnan(b)
                with np.errstate(invalid="ignore"):
                    counts += [np.count_nonzero(c & here) for c in ((a < -1) | (a > 1), ~lost & (np.abs(a - b) > 1e-12), lost)]
        yield pa.RecordBatch.from_arrays([pa.array([int(c)]) for c in counts], names=["out_of_range", "asymmetric", "unmatched"])

    counts = _on_pairs(_in_pairs(rows, width, (genes,)), [], matrix, work, "out_of_range long, asymmetric long, unmatched long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])
