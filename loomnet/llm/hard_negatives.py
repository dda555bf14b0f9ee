"""Hard negatives by full sorts of integer scores, anchor by anchor.

For an anchor every row's score is worked out and all are sorted by score and id; each positive's score then bounds where its negatives begin, found by binary
search, and the first few rows of another label are read from there down to the lower limit. No index takes part, so the result is exact.

Spark's part: rows lie in blocks by a hash of their id, anchors in blocks of their own, and a task sorts what one block has for one block of anchors; a block
leaves its first few rows, of which the best of all blocks are taken by one window. The work is anchors x rows, as stated; a task's memory is not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.llm.common import materialize

#: Rows and anchors of a pair of blocks, the fewest rows that are worth a block, and how many scores a task holds at once.
ROWS, ANCHORS, LEAST, SCORES = 65_536, 4096, 2048, 4_000_000
EXACT = 2**53


def labelled(vectors: DataFrame, label: Column, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, label, v (doubles) of rows with an id, a label and finite components.

    Rows that repeat an id count once, the smallest vector and then label."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as int64: by floating point where every partial sum is a whole number below 2^53, else in whole numbers."""
    most = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    if max(most) >= 2.0**63 or most[0] * most[1] * a.shape[1] >= 2.0**63:
        raise OverflowError("scores of these vectors don't fit 64-bit whole numbers")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """A block of rows in ascending order of their id, so that a stable sort by score alone is the sort by score and id."""

    def __init__(self, table: pa.Table, width: int):
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids)
        self.ids, self.labels = ids[order], table["label"].to_numpy()[order]
        self.vectors = _matrix(table["v"], width)[order]

    def sorts(self, anchors: np.ndarray):
        """For anchor after anchor: its number, the order of all rows from the highest score, and their scores in that order."""
        step = max(1, SCORES // max(1, len(self.ids)))
        for a in range(0, len(anchors), step):
            for k, scores in enumerate(_scores(anchors[a : a + step], self.vectors), a):
                order = np.lexsort((self.ids, -scores))
                yield k, order, scores[order]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row where ``is_anchor`` (on vec_id) holds and each of its
    ``positives`` best other rows of the same label, the first ``negatives`` rows of another label with
    lower * positive_score <= 100 * negative_score <= upper * positive_score. Higher scores come first, ties by smaller vec_id.

    ``label`` is worked out on the input, by default its own column. Rows without id or label, or whose vector is null, holds null or non-finite components or
    has another length than most, take no part; an id that repeats counts once. Positives of a negative score have an empty range where upper > lower.
    An anchor without positives, or a positive without negatives, gives no rows; an empty table none. Scores beyond 64-bit whole numbers raise an OverflowError."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = labelled(vectors, F.col("label") if label is None else label)
    rows = materialize(rows.mapInArrow(_whole(scale), "vec_id long, label long, v binary, width int"), "labelled")
    size = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    if size is None:
        return spark.createDataFrame([], schema)
    width, total = size["width"], int(size["count"])
    rows = rows.where(F.col("width") == width).drop("width")
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("asked"))
    blocks = max(-(-total // ROWS), min(-(-total // LEAST), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sets = max(1, -(-anchors.count() // ANCHORS))
    block = lambda n, by: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select(block(blocks, "vec_id").alias("b"), every(sets).alias("s"), "vec_id", "label", "v").groupBy("b", "s")

    def asked(which: DataFrame):
        return which.select(every(blocks).alias("b"), block(sets, "anchor_id").alias("s"), *which.columns).groupBy("b", "s")

    def same_label(key, table, wanted):
        out = []
        if table.num_rows and wanted.num_rows:
            own, ids, labels = Block(table, width), wanted["anchor_id"].to_numpy(), wanted["anchor_label"].to_numpy()
            for k, order, scores in own.sorts(_matrix(wanted["asked"], width)):
                near = np.flatnonzero((own.labels[order] == labels[k]) & (own.ids[order] != ids[k]))[:positives]
                out.append((np.full(len(near), ids[k]), own.ids[order[near]], scores[near]))
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    def other_label(key, table, wanted):
        out = []
        if table.num_rows and wanted.num_rows:
            own, ids, labels = Block(table, width), wanted["anchor_id"].to_numpy(), wanted["anchor_label"].to_numpy()
            of, limits = wanted["positive_ids"].to_pylist(), wanted["positive_scores"].to_pylist()
            for k, order, scores in own.sorts(_matrix(wanted["asked"], width)):
                other = own.labels[order] != labels[k]
                order, falling = order[other], -scores[other]
                for positive, score in zip(of[k], limits[k], strict=True):
                    # whole numbers: 100 n <= upper p is n <= floor(upper p / 100), and 100 n >= lower p is n >= ceil(lower p / 100)
                    begin = np.searchsorted(falling, -(upper * score // 100), "left")
                    end = np.searchsorted(falling, lower * -score // 100, "right")
                    part = slice(begin, max(begin, min(begin + negatives, end)))
                    n = part.stop - part.start
                    out.append((np.full(n, ids[k]), np.full(n, positive), own.ids[order[part]], np.full(n, score), -falling[part]))
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    best = lambda by, score, name: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), name))
    near = base.cogroup(asked(anchors)).applyInArrow(same_label, "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("nth", best(["anchor_id"], "positive_score", "positive_id")).where(F.col("nth") <= positives)
    chosen = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))  # ``positives`` at most
    chosen = materialize(chosen.select("anchor_id", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")), "positives")
    hard = base.cogroup(asked(anchors.join(chosen, "anchor_id"))).applyInArrow(other_label, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ranked = hard.withColumn("rank", best(["anchor_id", "positive_id"], "negative_score", "negative_id").cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _whole(scale: float):
    """Every component x as floor(scale * x), a whole number kept in a double; vectors as bytes."""

    def run(batches):
        for batch in batches:
            each = [np.floor(scale * np.array(v, np.float64)) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in each], pa.binary()), pa.array([len(v) for v in each], pa.int32())], names=["vec_id", "label", "v", "width"])

    return run


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({name: np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]).astype(np.int64) for c, name in enumerate(names)})
