"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed five-word shingles; equal sets make one class, which takes part once. In every run all classes start in one
bucket. A bucket samples one or two tokens from each of its sets - 1 / threshold of them on average - as the shingles that hash functions of the run,
the level and the branch rank least, and sends the set down a path for each: sets that chose the same token share the next bucket. Buckets of
more than ``leaf`` classes are split again, small ones are compared in full. Runs are repeated until a pair at the threshold is missed with a
probability below 1 - recall, also if all its buckets were split to the last level.

Comparing a bucket takes sketches, every pair of it: they are cheap to send to each of a set's buckets, and miss a pair at the threshold with a
probability of at most ``MISS``, which the runs make up for. A bucket that is large at the last level holds sets that are much alike; there all are compared with one of
them, and only those that are far from it with all others, block by block. Either way only a spanning forest of the likely pairs leaves.

What hangs together is then compared exactly, on the sets themselves. Parts of up to ``BLOCK`` sets are compared pair by pair. In larger parts each
set is written as its difference from one of them: of weight w for every token missing and 1 - w for every token added. Two sets whose
weights together stay below a bound that follows from the size of that one set are linked whatever the differences are; how many such partners a set has is a rank among weights. Only sets
of more than half that weight are compared with others, block by block, by their (short) differences. So a group of copies or near copies
makes rows in proportion to its size, links are counted, not listed, and none is lost."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.llm.common import bounded_batches, group_count, hash_words, materialize, mix, pieces, split_words, text_bytes, window_hashes

SKETCH = 64  # coordinates of a sketch, two bytes each
MISS = 0.0005  # the share of pairs at the threshold whose sketches may differ too much
LEVELS = 3
BLOCK = 128
#: Weights of differences are whole numbers of this many to a token; what rounding may cost is SLACK of them.
UNITS, SLACK = 1_000_000, 3


def branches(threshold: float) -> tuple[int, float]:
    """How many tokens every bucket samples, and the share of buckets that sample one more: 1 / threshold on average."""
    each = math.floor(1 / threshold + 1e-9)
    return each, max(0.0, 1 / threshold - each)


def survival(threshold: float, levels: int = LEVELS) -> float:
    """The probability that a pair at the threshold still shares a bucket after so many levels."""
    (each, share), alive = branches(threshold), 1.0
    for _ in range(levels):
        apart = 1 - threshold * alive
        alive = (1 - share) * (1 - apart**each) + share * (1 - apart ** (each + 1))
    return alive


def run_count(threshold: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold was together at the last level with probability ``recall``."""
    alive = survival(threshold, levels)
    return 1 if alive >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's different shingles; a text of fewer words, but not none, is one shingle."""
    words, first = split_words(data, offsets)
    h = hash_words(words)
    w = window_hashes(h, n)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(w[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the least hash among the tokens; a few tokens at a time, so that long sets don't add up."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        x = s[k : k + 4096, None] * seeds[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0), out=out)
    return out


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame, n: int, tokens: int) -> DataFrame:
    """doc_id, size, class key (k1, k2), sampled tokens (paths) and sketch of every document."""
    bounded_batches(docs.sparkSession)
    seeds = _seeds(tokens + SKETCH)

    def sign(batches):
        for batch in pieces(batches, "text", 2_000_000):
            sets = shingle_sets(*text_bytes(batch.column("text")), n)
            least = np.stack([_least(s, seeds) for s in sets])
            paths = pa.FixedSizeListArray.from_arrays(pa.array(mix(least[:, :tokens]).view(np.int64).ravel()), tokens).cast(pa.list_(pa.int64()))
            sketch = (mix(least[:, tokens:]) & np.uint64(0xFFFF)).astype(np.uint16)
            k1, k2 = _keys(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(k1), pa.array(k2), paths, pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["doc_id", "size", "k1", "k2", "paths", "sketch"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(sign, "doc_id long, size int, k1 long, k2 long, paths array<long>, sketch binary")


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def buckets(reps: DataFrame, runs: int, leaf: int, threshold: float) -> DataFrame:
    """node, bucket, members, head (the least node in it): the buckets of every class in which it isn't alone, split level by level while they are large."""
    each, share = branches(threshold)
    width = each + (share > 0)
    run = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("paths", r * LEVELS * width + 1, LEVELS * width))).alias("run", "path")
    open_ = reps.select("node", run).select("node", "path", F.xxhash64("run").alias("bucket"))
    done = None
    for level in range(LEVELS):
        more = (F.pmod(F.xxhash64("bucket", F.lit(level)), F.lit(1_000_000)) < int(share * 1_000_000)).cast("int")
        chosen = F.transform(F.sequence(F.lit(0), F.lit(each - 1) + more), lambda b: F.xxhash64("bucket", b, F.element_at("path", b + (level * width + 1))))  # noqa: B023
        open_ = open_.select("node", "path", F.explode(chosen).alias("bucket"))
        # a table of its own, so that the join is of two plain shuffles, whose hot buckets Spark can split
        sizes = materialize(open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("head")).where("members > 1"), "sizes")
        split = (F.col("members") > leaf) if level < LEVELS - 1 else F.lit(False)
        met = materialize(open_.join(sizes, "bucket").select("node", "bucket", "members", "head", split.alias("split"), F.when(split, F.col("path")).alias("path")), "met")
        small = met.where("not split").select("node", "bucket", "members", "head")
        done = small if done is None else done.unionByName(small)
        open_ = met.where("split").select("node", "path", "bucket")
    return done


def _common(sets: list[np.ndarray], asks: int | None = None) -> np.ndarray:
    """The sizes of the intersections of the first ``asks`` sets (of all, if not given) with all others (with all), from products of
    0/1 matrices over the tokens that two sets share."""
    m = len(sets)
    rows = slice(0, m) if asks is None else slice(0, asks)
    columns = slice(0, m) if asks is None else slice(asks, m)
    out = np.zeros((rows.stop, m - columns.start), np.float32)
    if not m:
        return out
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return out
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    step = max(1, 4_000_000 // m)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            grid = np.zeros((m, min(step, column[b - 1] - k * step + 1)), np.float32)
            grid[owner[a:b], column[a:b] - k * step] = 1
            out += grid[rows] @ grid[columns].T
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric 0/1 matrix reaches."""
    label = np.arange(len(linked))
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _sketch_least(threshold: float, miss: float = MISS) -> int:
    """Coordinates that must agree: the most that a pair at the threshold falls short of with a probability of at most ``miss``."""
    below, least = 0.0, 0
    while least < SKETCH:
        below += math.comb(SKETCH, least) * threshold**least * (1 - threshold) ** (SKETCH - least)
        if below > miss:
            break
        least += 1
    return max(1, least)


def _groups(table: pa.Table, keys: list[str]):
    """The tables of rows that agree in the keys."""
    if not table.num_rows:
        return
    table = table.combine_chunks().sort_by([(k, "ascending") for k in keys])
    values = [table[k].to_numpy() for k in keys]
    new = np.flatnonzero(np.append(True, np.any([v[1:] != v[:-1] for v in values], axis=0)))
    for a, b in zip(new, np.append(new[1:], table.num_rows), strict=True):
        yield table.slice(a, b - a)


def _alike(sketch: list[bytes], size: np.ndarray, threshold: float, asks: int | None = None) -> np.ndarray:
    """Which pairs are likely by their sketches and sizes: of all, or of the first ``asks`` with all others."""
    x, size = np.frombuffer(b"".join(sketch), np.uint16).reshape(len(sketch), SKETCH), size.astype(np.float64)
    a, b = (slice(0, None),) * 2 if asks is None else (slice(0, asks), slice(asks, None))
    same = np.zeros((len(x[a]), len(x[b])), np.int16)
    for k in range(SKETCH):
        same += x[a, k, None] == x[None, b, k]
    least, most = np.minimum(size[a, None], size[None, b]), np.maximum(size[a, None], size[None, b])
    return (same >= _sketch_least(threshold)) & (least >= threshold * most - 1e-9)


def _edges(node: np.ndarray, linked: np.ndarray, asks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, to) of linked pairs."""
    if asks is not None:
        square = np.zeros((len(node), len(node)), bool)
        square[:asks, asks:] = linked
        linked = square | square.T
    label = _forest(linked)
    own = np.flatnonzero(label != np.arange(len(node)))
    return node[own], node[label[own]]


def _slot(slots: int, *keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("slot")


def _against(asking: DataFrame, base: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``asking`` and ``base`` (with key, node, and the key's totals n_asks and n_base) in cells (key, i, j) of at most BLOCK of each
    on average, so that each row that asks meets each of the base once. Adds asks (boolean)."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    a = asking.select(key, *columns, F.lit(True).alias("asks"), mine("n_asks").alias("i"), every("n_base").alias("j"))
    b = base.select(key, *columns, F.lit(False).alias("asks"), every("n_asks").alias("i"), mine("n_base").alias("j"))
    return a.unionByName(b)


def likely_pairs(met: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """node, to: a forest of likely pairs of every bucket."""
    sketches = reps.select("node", "size", "sketch")
    slots = group_count(met, 0.5)

    def whole(key, table):
        out = [_edges(c["node"].to_numpy(), _alike(c["sketch"].to_pylist(), c["size"].to_numpy(), threshold)) for c in _groups(table, ["bucket"])]
        return _pairs(out)

    small = met.where(F.col("members") <= BLOCK).join(sketches, "node").withColumn("slot", _slot(slots, "bucket"))
    found = small.groupBy("slot").applyInArrow(whole, "node long, to long")
    large = met.where(F.col("members") > BLOCK)
    if not large.limit(1).count():
        return found

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SKETCH) for c in ("sketch", "head_sketch"))
            size, other = (batch.column(c).to_numpy().astype(np.float64) for c in ("size", "head_size"))
            ok = ((x == y).sum(axis=1) >= _sketch_least(threshold)) & (np.minimum(size, other) >= threshold * np.maximum(size, other) - 1e-9)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "node", "head", "members", "size", "sketch")), pa.array(ok)], names=["bucket", "node", "head", "members", "size", "sketch", "near"])

    heads = materialize(large.select("head").distinct().join(sketches.withColumnRenamed("node", "head"), "head").select("head", F.col("size").alias("head_size"), F.col("sketch").alias("head_sketch")), "heads")
    judged = large.join(sketches, "node").join(heads, "head").mapInArrow(near, "bucket long, node long, head long, members long, size int, sketch binary, near boolean")
    judged = materialize(judged, "judged")
    found = found.unionByName(judged.where("near and node <> head").select("node", F.col("head").alias("to")))
    far = materialize(judged.where("not near").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_asks")), "far")
    counted = judged.join(far, "bucket").withColumn("n_base", F.col("members"))
    cells = _against(counted.where("not near"), counted, "bucket", ["node", "size", "sketch"]).withColumn("slot", _slot(slots, "bucket", "i", "j"))

    def across(key, table):
        out = []
        for c in _groups(table, ["bucket", "i", "j"]):
            c = c.sort_by([("asks", "descending")])
            asks = int(c["asks"].to_numpy(zero_copy_only=False).sum())
            out.append(_edges(c["node"].to_numpy(), _alike(c["sketch"].to_pylist(), c["size"].to_numpy(), threshold, asks), asks))
        return _pairs(out)

    return found.unionByName(cells.groupBy("slot").applyInArrow(across, "node long, to long"))


def _pairs(out: list) -> pa.Table:
    return pa.table({name: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k, name in enumerate(("node", "to"))})


def connected(edges: DataFrame, name: str = "connected") -> DataFrame:
    """node, root: the least node of the part that each node of ``edges`` (node, to) is in. Alternates large-star and small-star
    steps, each a minimum by key and a join, until nothing changes; every step is a table in the shared folder."""
    edges = materialize(edges.select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).where("node <> to").distinct(), name)
    # all that a node leads to is led to the least of that, so that edges from many blocks fold into one a node before they are doubled
    least = materialize(edges.groupBy("node").agg(F.min("to").alias("m")), name)
    edges = materialize(edges.join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).where("node <> to").unionByName(least.withColumnRenamed("m", "to")).distinct(), name)
    last = None
    while True:
        # minima are tables of their own, so that their joins are of two plain shuffles, whose hot nodes Spark can split
        both = edges.select(F.explode(F.array(F.struct("node", "to"), F.struct(F.col("to").alias("node"), F.col("node").alias("to")))).alias("e")).select("e.node", "e.to")
        least = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("m")), name)
        large = materialize(both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).distinct(), name)
        least = materialize(large.groupBy("node").agg(F.min("to").alias("m")), name)
        small = large.join(least, "node")
        small = small.select(F.explode(F.array(F.struct("node", F.col("m").alias("to")), F.struct(F.col("to").alias("node"), F.col("m").alias("to")))).alias("e")).select("e.node", "e.to").where("node <> to").distinct()
        edges = materialize(small, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.groupBy("node").agg(F.min("to").alias("root"))


def exact_links(sent: DataFrame, threshold: float, n: int, slots: int) -> DataFrame:
    """node, n_links, to: how many others of its part each node is linked to (in several rows that add up) and a forest of the links.

    ``sent`` has text, k1, k2, node, root and members (how many nodes the root's part has)."""
    share = threshold / (1 + threshold)  # linked if the intersection is at least this share of both sizes together
    chunks = F.ceil(F.col("members") / BLOCK).cast("int")
    chunk = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))  # the root goes everywhere
    dealt = sent.select("text", "k1", "k2", "node", "root", chunks.alias("chunks"), chunk.alias("to"))

    def sets(batches):
        for batch in pieces(batches, "text", 2_000_000):
            each = shingle_sets(*text_bytes(batch.column("text")), n)
            k1, k2 = _keys(each)
            ok = (k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())  # an id may have other texts
            rows = [(root, c, chunks, node, s.tobytes()) for k, (root, to, chunks, node, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "to", "chunks", "node")), each, strict=True)) if ok[k] for c in to]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["root", "chunk", "chunks", "node", "tokens"])

    def compare(key, table):
        out = []
        for part in _groups(table, ["root", "chunk"]):
            _, once = np.unique(part["node"].to_numpy(), return_index=True)  # repeated rows
            part = part.take(once)
            node, root, chunk, many = part["node"].to_numpy(), part["root"][0].as_py(), part["chunk"][0].as_py(), part["chunks"][0].as_py() > 1
            own = [np.frombuffer(x, np.uint64) for x in part["tokens"].to_pylist()]
            if many:
                base = own[int(np.flatnonzero(node == root)[0])]
                for v, x in zip(node.tolist(), own, strict=True):
                    if v == root and chunk:
                        continue  # it counts once
                    apart = np.setxor1d(base, x, assume_unique=True)
                    added = (len(x) - len(base) + len(apart)) // 2
                    weight = round(UNITS * ((1 - share) * (len(apart) - added) + share * added))
                    out.append((root, v, 0, v, weight, round(UNITS * (1 - 2 * share) * len(base)) + SLACK, apart.tobytes()))
                continue
            common, size = _common(own), np.array([len(x) for x in own], np.float64)
            linked = common >= threshold * (size[:, None] + size - common) - 1e-6
            np.fill_diagonal(linked, False)
            out += [(root, v, k, to, None, None, None) for v, k, to in zip(node.tolist(), linked.sum(axis=1).tolist(), node[_forest(linked)].tolist(), strict=True)]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("root", "node", "n_links", "to", "weight", "bound", "apart"), columns, kinds, strict=True)})

    told = dealt.mapInArrow(sets, "root long, chunk int, chunks int, node long, tokens binary")
    compared = told.withColumn("slot", _slot(slots, "root", "chunk")).groupBy("slot").applyInArrow(compare, "root long, node long, n_links long, to long, weight long, bound long, apart binary")
    compared = materialize(compared, "compared")
    large = compared.where("weight is not null")
    found = compared.where("weight is null and n_links > 0").select("node", "n_links", "to")
    if not large.limit(1).count():
        return found

    # partners that are linked by weight alone: a rank among the weights of the part, of which there are no more than differences can have
    heap = large.groupBy("root", "bound", "weight").agg(F.count(F.lit(1)).alias("n"))
    points = heap.select("root", "weight", F.col("weight").alias("at"), "n", F.lit(0).alias("asks")).unionByName(heap.select("root", "weight", (F.col("bound") - F.col("weight")).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asks")))
    rank = F.sum("n").over(W.partitionBy("root").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = points.withColumn("free", rank).where("asks = 1").select("root", "weight", "free")
    free = large.join(ranks, ["root", "weight"]).select(
        "node", (F.col("free") - (2 * F.col("weight") <= F.col("bound")).cast("long")).alias("n_links"), F.when(F.col("weight") <= F.col("bound"), F.col("root")).otherwise(F.col("node")).alias("to")
    )
    # the rest: every set of more than half the bound against all that it isn't linked to by weight alone
    heavy = 2 * F.col("weight") > F.col("bound")
    totals = large.groupBy("root").agg(F.count_if(heavy).alias("n_asks"), F.max("weight").alias("top")).where("n_asks > 0")
    asked = large.join(totals, "root").where(F.col("weight") + F.col("top") > F.col("bound"))
    sizes = materialize(asked.groupBy("root").agg(F.count(F.lit(1)).alias("n_base"), F.first("n_asks").alias("n_asks")), "heavy")
    asked = large.join(totals.drop("n_asks"), "root").where(F.col("weight") + F.col("top") > F.col("bound")).join(sizes, "root")
    cells = _against(asked.where(heavy), asked, "root", ["node", "weight", "bound", "apart"]).withColumn("slot", _slot(group_count(large, 0.5), "root", "i", "j"))

    def weigh(key, table):
        out = []
        for c in _groups(table, ["root", "i", "j"]):
            c = c.sort_by([("asks", "descending")])
            asks = int(c["asks"].to_numpy(zero_copy_only=False).sum())
            node, weight = c["node"].to_numpy(), c["weight"].to_numpy()
            over = weight[:asks, None] + weight[None, asks:] - c["bound"][0].as_py()
            common = _common([np.frombuffer(x, np.uint64) for x in c["apart"].to_pylist()], asks)
            linked = (over > 0) & (common.astype(np.float64) * UNITS >= over) & (node[:asks, None] != node[None, asks:])
            light = 2 * weight[asks:] <= c["bound"][0].as_py()  # those don't ask, so the pair counts here for both
            v, to = _edges(node, linked, asks)
            out.append((np.concatenate([node[:asks], node[asks:][light], v]), np.concatenate([linked.sum(axis=1), linked[:, light].sum(axis=0), np.zeros(len(v), np.int64)]), np.concatenate([node[:asks], node[asks:][light], to])))
        return pa.table({name: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]).astype(np.int64) for k, name in enumerate(("node", "n_links", "to"))})

    return found.unionByName(free).unionByName(cells.groupBy("slot").applyInArrow(weigh, "node long, n_links long, to long").where("n_links > 0 or node <> to"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, leaf: int = 64) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, group_id, one row a document.

    class_id is the smallest doc_id with the same set of shingles (null if all are null), n_copies how many documents have it, n_links the number of other
    classes with a Jaccard similarity of at least ``threshold``, and group_id the smallest doc_id that links and copies lead to. Words
    are parted by white space and not changed; a text of fewer than ``n`` words is one shingle. Null, empty and blank texts have no shingles: each is a class
    and a group of its own (class_id = group_id = doc_id, n_copies 1, n_links 0). Repeated rows are copies. An empty table gives none."""
    runs = run_count(threshold, min(recall + MISS, 1 - MISS / 10))
    each, share = branches(threshold)
    signed = materialize(signatures(docs, n, runs * LEVELS * (each + (share > 0))), "signatures")
    reps = signed.where("size > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, when the table is written
    met = materialize(buckets(reps.select("node", "paths"), runs, leaf, threshold), "buckets")
    parts = connected(likely_pairs(met, reps, threshold), "likely")
    parts = materialize(parts.unionByName(parts.select(F.col("root").alias("node"), "root")).distinct(), "parts")
    parts = parts.join(materialize(parts.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "members"), "root").join(reps.select("node", "k1", "k2", "class_id"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null")
    sent = texts.join(parts, F.col("doc_id").eqNullSafe(F.col("class_id"))).select("text", "k1", "k2", "node", "root", "members")
    checked = materialize(exact_links(sent, threshold, n, group_count(docs, 2.0)), "links")
    roots = connected(checked.select("node", "to"), "linked")
    links = checked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    owners = reps.select("k1", "k2", "node", "class_id", "n_copies").join(links, "node", "left").join(roots, "node", "left")
    owners = owners.withColumn("root", F.coalesce("root", "node"))
    owners = owners.join(owners.groupBy("root").agg(F.min("class_id").alias("group_id")), "root")
    rows = signed.select("doc_id", "size", "k1", "k2").join(owners.select("k1", "k2", "class_id", "n_copies", "n_links", "group_id"), ["k1", "k2"], "left")
    full = F.col("size") > 0
    return rows.select(
        "doc_id",
        F.when(full, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(full, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(full, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each group of copies and near copies only the smallest doc_id does.

    Rows without an id stay, and so do texts without words. Of rows that share the kept id all stay."""
    gone = jaccard_join(docs.select("doc_id", "text"), threshold, n).where("doc_id <> group_id").select(F.col("doc_id").alias("__loom_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__loom_id"], "left_anti")
