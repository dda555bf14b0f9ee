"""Decontamination: what travels, what joins are keyed by, and equal results by broadcast and by shuffle."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

pytest.importorskip("public_tokenizers")

from loomnet.llm import decontamination  # noqa: E402

ITEMS = [(1, "what is the tallest mountain in the world and where does it stand today"), (2, "Short item"), (3, None), (None, "one two three four five six seven eight nine ten eleven"), (4, "short item"), (5, "")]
DOCS = [
    (1, "x y " + ITEMS[0][1].upper() + " z"), (2, "a short item, and again: SHORT ITEM"), (3, None), (3, ""), (None, "one two three four five six seven eight nine ten"), (None, "nothing"),
    (4, "what is the tallest mountain"), (4, "what is the tallest mountain"), (5, "word " * 5000 + ITEMS[0][1]), (6, "one two three four five six seven eight nine TEN eleven one two three four five six seven eight nine ten"),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in DOCS], "doc_id long, text string, w int, k string").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_both_ways(spark, rows):
    docs, items = frames(spark)
    out = decontamination.decontaminate(docs, items, broadcast_rows=rows).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, brute.decontaminate(DOCS, ITEMS)))


def test_windows_travel_as_hashes_and_join_on_them(spark):
    docs, items = frames(spark)
    for rows, kind in ((1_000_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        text = decontamination.decontaminate(docs, items, broadcast_rows=rows)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in text.splitlines() if kind in line and "wh" in line]
        assert joins
        for line in joins:
            keys = re.search(r"Join \[([^\]]*)\], \[([^\]]*)\]", line).groups()
            assert [re.sub(r"#\w+", "", key) for key in keys] == ["wh, k", "h, len"], line
        if not rows:
            for line in text.splitlines():
                if "Generate posexplode" in line:
                    assert not re.search(r"\bw#", line.split("],")[0].split("[", 2)[-1]), line
