"""Suffix-array dedup: work on crowded anchors is spread over tasks, passages of words go by their bytes."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

pytest.importorskip("public_tokenizers")

from loomnet.llm import suffix_dedup  # noqa: E402

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def checked(spark, docs, **more):
    """The operator's rows by id; they equal a count of all windows."""
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **more).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.suffix_dedup(docs, more["length"]))
    return {r.doc_id: r for r in rows}


def test_parts_of_crowded_anchors_are_sorted_in_several_tasks(spark, monkeypatch):
    """Sixty documents around parts of one passage; the parts are few bytes, which Spark by itself puts together in one task."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    core, tasks = text(300), []
    docs = [(k, text(rng.randrange(40, 90)) + core[rng.randrange(0, 60) : rng.randrange(200, 300)] + text(50)) for k in range(60)]

    def spied(df, name):
        if name == "marks":
            tasks.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return kept(df, name)

    kept = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", spied)
    checked(spark, docs, length=60, most=2)
    assert tasks and max(tasks) > 1


def test_passages_of_over_fifty_words_go_by_their_bytes(spark):
    """A passage in two documents goes from both if it has 400 bytes, however many words that is; documents without one lose nothing."""
    rng = random.Random(4)
    prose = lambda n, most: " ".join("".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, most))) for _ in range(n))
    long, short, docs = prose(60, 14), prose(60, 7), []
    assert len(long) >= 400 > len(short) + 2
    for k, passage in enumerate([long, short, None]):
        docs += [(10 * k + i, prose(80, 9) + (f"\n{passage}\t" if passage else " ") + prose(80, 9)) for i in range(2)]
    found = checked(spark, docs, length=400)
    assert all(found[i].n_removed >= len(long) and found[i].n_spans == 1 for i in (0, 1))
    assert all(found[i].n_removed == 0 for i in (10, 11, 20, 21))
