"""Line dedup with overlapping three-line windows.

Each run of three lines is hashed (128 bits). A window that was seen before, in the order of doc_id and position, is a
later occurrence; the lines that later occurrences cover are merged and removed. First occurrences stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnet.llm.common import NULL_ID, bounded_batches, covered, materialize

ID, TEXT_HASH, STARTS = "__loom_id", "__loom_text", "__loom_starts"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), TEXT_HASH: F.xxhash64(F.coalesce("text", F.lit("")))})


def later_windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """For each document that has any, the first lines (from 0) of its windows that occurred before: a sorted array."""
    cut = _keyed(docs.select("doc_id", "text")).select(ID, TEXT_HASH, F.split("text", "\n").alias("ls")).where(F.size("ls") >= lines)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("ls") - lines),
        lambda i: F.struct(F.xxhash64(F.slice("ls", i + 1, lines)).alias("a"), F.xxhash64(F.reverse(F.slice("ls", i + 1, lines)), F.lit(lines)).alias("b")),
    )
    windows = cut.select(ID, TEXT_HASH, F.posexplode(hashed).alias("at", "h")).select(ID, TEXT_HASH, "at", "h.a", "h.b")
    place = F.struct(ID, TEXT_HASH, "at")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    firsts = materialize(firsts, "windows")  # a table of its own, so that the join is of two plain shuffles, whose hot windows Spark can split
    return windows.join(firsts, ["a", "b"]).where(place > F.col("first")).groupBy(ID, TEXT_HASH).agg(F.sort_array(F.collect_set("at")).alias(STARTS))


def line_dedup(docs: DataFrame, lines: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and n_lines and n_removed (long).

    A text without lines removed is returned as it was (null as null). Null and empty texts have no lines, other texts one
    more than line feeds; texts of fewer than ``lines`` lines lose nothing. A null doc_id sorts after all ids. Rows that
    agree in doc_id and text are one document and are treated alike; rows that share only the id are ordered by their text's hash.
    Columns named n_lines or n_removed are replaced. An empty table gives none."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for batch in batches:
            texts, lost = batch.column("text"), batch.column(STARTS)
            long = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
            n_lines = np.where(long, pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False) + 1, 0).astype(np.int64)
            n_removed, cut_texts = np.zeros(batch.num_rows, np.int64), []
            hit = lost.is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(hit).tolist():  # only texts that lose lines are taken apart
                gone = covered(np.array(lost[k].as_py()), lines, int(n_lines[k]))
                cut_texts.append("\n".join(x for x, g in zip(texts[k].as_py().split("\n"), gone.tolist(), strict=True) if not g))
                n_removed[k] = int(gone.sum())
            if cut_texts:
                texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(cut_texts, texts.type))
            arrays = [texts if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(n_removed)], names=[*columns, "n_lines", "n_removed"])

    bounded_batches(docs.sparkSession)
    return _keyed(docs.select(*columns)).join(later_windows(docs, lines), [ID, TEXT_HASH], "left").select(*columns, STARTS).mapInArrow(cut, schema)
