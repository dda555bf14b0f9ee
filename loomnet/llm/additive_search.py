"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each codebook. Codebooks are fitted to what the ones before left over, then jointly by
least squares; encoding is a beam search over all codebooks. Each code is stored with its norm: the ratio of the vector's own length to its
reconstruction's, which every score is scaled by, as sums of codewords come out too short. A query's inner products with all codewords make
lookup tables, so a candidate's score is a sum of table entries times its stored norm. The best of the whole index by that make one shortlist a
query, which is scored again on the original vectors in double precision.

Spark's part: only codes (a few bytes a vector) are scanned, in blocks of the index against blocks of queries, and each pair of blocks leaves its share of the
shortlist. Original vectors stay where they are: shortlists go to the blocks that hold their vectors, each query's vector once a block, and
blocks that very many queries ask are split by query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnet.llm.common import materialize

#: Codes and queries of a pair of blocks; original vectors of a block, and how many scores are worked out on one at once.
INDEX_BLOCK, QUERY_BLOCK, FETCH_BLOCK, FETCHED = 65_536, 16_384, 8192, 200_000


@dataclass
class Codebooks:
    words: np.ndarray  # codebooks x entries x dimensions, float32

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """The codes of vectors, by beam search: the ``beam`` best partial sums are kept from codebook to codebook."""
        m, k, d = self.words.shape
        x = x.astype(np.float32)
        norms = (self.words**2).sum(2)
        out = np.zeros((len(x), m), np.uint8)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            n, rows = len(part), np.arange(len(part))[:, None]
            codes = np.zeros((n, 1, 0), np.int64)
            rest, error = part[:, None, :], np.zeros((n, 1), np.float32)  # what is left to code, and the squared error without |x|^2
            for j, book in enumerate(self.words):
                total = (error[:, :, None] + norms[j] - 2 * (rest @ book.T)).reshape(n, -1)
                best = np.argpartition(total, min(beam, total.shape[1]) - 1, axis=1)[:, :beam]
                error = total[rows, best]
                codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], axis=2)
                rest = rest[rows, best // k] - book[best % k]
            out[a : a + n] = codes[np.arange(n), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for j, book in enumerate(self.words):
            out += book[codes[:, j]]
        return out


def _means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def fit(x: np.ndarray, books: int = 16, entries: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks for a sample: k-means on residuals, then one joint least-squares step on beam-searched codes."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    entries = min(entries, 256, len(x))  # a code is a byte
    words, rest = [], x.copy()
    for _ in range(books):
        words.append(_means(rest, entries, rounds, rng))
        rest -= words[-1][(-2 * rest @ words[-1].T + (words[-1] ** 2).sum(1)).argmin(1)]
    own = Codebooks(np.stack(words))
    codes = own.encode(x).astype(np.int64) + entries * np.arange(books)
    pairs = np.zeros((books * entries,) * 2)
    for i in range(books):
        for j in range(books):
            np.add.at(pairs, (codes[:, i], codes[:, j]), 1)
    sums = np.zeros((books * entries, x.shape[1]))
    for i in range(books):
        np.add.at(sums, codes[:, i], x)
    start = own.words.reshape(-1, x.shape[1]).astype(np.float64)
    pairs.flat[:: len(pairs) + 1] += 1  # ridge towards the first codebooks
    solved = np.linalg.solve(pairs, sums + start)
    return Codebooks(solved.reshape(own.words.shape).astype(np.float32))


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of vectors that take part: not null, not zero, no null or non-finite component."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def block_share(shortlist: int, blocks: int) -> int:
    """How many of a shortlist to take from each of several blocks. Blocks are dealt by hash, so the best are spread as by chance: six deviations above the mean.
    Only ids that were chosen against the hash could put more into one block; such a shortlist would be cut there."""
    mean = shortlist / blocks
    return shortlist if blocks == 1 else min(shortlist, int(np.ceil(mean + 6 * np.sqrt(mean) + 6)))


def sampled(total: int, rows: int) -> Column:
    """Which of ``total`` vectors are looked at for a sample of ``rows``, by a hash of vec_id over all 64 bits; twice as many, of which the first are taken, so that it is never empty by rounding."""
    share = min(1.0, 2 * rows / total)
    return F.lit(True) if share == 1 else F.xxhash64("vec_id") < int(-(2**63) + 2**64 * share)


def shortlist_for(total: int) -> int:
    """The length of a shortlist: 512 up to 20,000 vectors, from there with the root of their number, as recall at a fixed length falls when the index grows."""
    return int(np.ceil(512 * max(1.0, total / 20_000) ** 0.5))


def additive_search(vectors: DataFrame, is_query: Column, k: int = 20, books: int = 16, sample_rows: int = 8192, shortlist: int | None = None, beam: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where ``is_query`` (on vec_id) holds, the ``k`` rows of largest inner product among all
    others that were found, exactly scored, nearest first and ties to the smaller vec_id.

    Codebooks are fitted to at most ``sample_rows`` vectors, chosen by a hash of their id; every row is encoded. The ``shortlist`` (by default shortlist_for() their number) best of the index by
    lookup (ties to the smaller vec_id, so equal vectors come in the right order) are scored exactly. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor do rows without an id. Rows that repeat an id count once (the smallest vector). Empty tables give none."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = int(size["count"])
    sample = np.array([r[0] for r in rows.where(sampled(total, sample_rows)).select("v").orderBy(F.xxhash64("v")).limit(sample_rows).collect()])  # bounded by sample_rows
    if not len(sample):
        raise RuntimeError(f"none of {total} vectors is in the sample for fitting")
    books_ = spark.sparkContext.broadcast(fit(sample, books))
    shortlist = shortlist or shortlist_for(total)
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    stored = np.dtype("<f4" if single else "<f8")  # as exact as the source, half the bytes

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = books_.value.encode(v, beam)
            coded = np.linalg.norm(books_.value.decode(codes), axis=1)
            norm = np.linalg.norm(v, axis=1) / np.where(coded > 0, coded, 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in v.astype(stored)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["vec_id", "v", "codes", "norm"])

    index = materialize(rows.mapInArrow(encode, "vec_id long, v binary, codes binary, norm float"), "codes")
    queries = index.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("asked"))
    index_blocks = max(-(-total // INDEX_BLOCK), min(-(-total // FETCH_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda n, by="vec_id": F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = index.select(block(index_blocks).alias("b"), every(query_blocks).alias("q"), "vec_id", "codes", "norm")
    asked = queries.select(every(index_blocks).alias("b"), block(query_blocks, "query_id").alias("q"), "query_id", "asked")
    take = block_share(shortlist, index_blocks)

    def look_up(key, codes, asked):
        out = []
        if codes.num_rows and asked.num_rows:
            own = codes["vec_id"].to_numpy()
            order = np.argsort(own)
            own, norm = own[order], codes["norm"].to_numpy()[order]
            words = books_.value.words
            m, entries = words.shape[:2]
            code = np.frombuffer(b"".join(codes["codes"].to_pylist()), np.uint8).reshape(-1, m)[order]
            places = np.ascontiguousarray((code.astype(np.int32) + entries * np.arange(m, dtype=np.int32)).T)
            vectors_ = np.frombuffer(b"".join(asked["asked"].to_pylist()), stored).reshape(asked.num_rows, -1).astype(np.float32)
            ids, flat = asked["query_id"].to_numpy(), words.reshape(m * entries, -1).T
            for a in range(0, len(ids), 256):
                for query, table in zip(ids[a : a + 256].tolist(), vectors_[a : a + 256] @ flat, strict=True):
                    scores = table[places[0]]
                    for j in range(1, m):
                        scores += table[places[j]]
                    scores *= norm
                    itself = np.searchsorted(own, query)
                    if itself < len(own) and own[itself] == query:
                        scores[itself] = -np.inf
                    n = min(take, len(own))
                    least = np.partition(scores, len(own) - n)[len(own) - n]
                    better = np.flatnonzero(scores > least)
                    near = np.concatenate([better, np.flatnonzero(scores == least)[: n - len(better)]])
                    near = near[scores[near] > -np.inf]
                    out.append((np.full(len(near), query), own[near], scores[near]))
        columns = [np.concatenate([np.zeros(0, np.float32 if c == 2 else np.int64), *(o[c] for o in out)]) for c in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1], "about": columns[2].astype(np.float32)})

    found = base.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(look_up, "query_id long, vec_id long, about float")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("about"), "vec_id"))
    short = found.withColumn("nth", nth).where(F.col("nth") <= shortlist).select("query_id", "vec_id", block(-(-total // FETCH_BLOCK)).alias("b"))
    wanted = short.groupBy("query_id", "b").agg(F.collect_list("vec_id").alias("wanted"))  # a shortlist at most
    wanted = materialize(wanted.join(queries, "query_id"), "shortlists")
    splits = materialize(wanted.groupBy("b").agg(F.ceil(F.sum(F.size("wanted")) / FETCHED).cast("int").alias("splits")), "splits")
    requests = wanted.join(splits, "b").select("b", F.pmod(F.xxhash64("query_id"), F.col("splits")).cast("int").alias("part"), "query_id", "asked", "wanted")
    originals = index.select(block(-(-total // FETCH_BLOCK)).alias("b"), "vec_id", "v").join(splits, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"), "vec_id", "v")

    def exact(key, requests, originals):
        own = originals["vec_id"].to_numpy()
        order = np.argsort(own)
        own, vectors_ = own[order], np.frombuffer(b"".join(originals["v"].to_pylist()), stored).reshape(len(own), -1).astype(np.float64)[order]
        out = []
        for query, asked, ids in zip(*(requests[c].to_pylist() for c in ("query_id", "asked", "wanted")), strict=True):
            near = np.searchsorted(own, np.array(ids))
            scores = (vectors_[near] * np.frombuffer(asked, stored).astype(np.float64)).sum(1)
            best = np.lexsort((own[near], -scores))[:k]
            out.append((np.full(len(best), query), own[near][best], scores[best]))
        columns = [np.concatenate([np.zeros(0, np.float64 if c == 2 else np.int64), *(o[c] for o in out)]) for c in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2]})

    scored = requests.groupBy("b", "part").cogroup(originals.groupBy("b", "part")).applyInArrow(exact, "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
