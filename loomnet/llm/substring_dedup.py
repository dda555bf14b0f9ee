"""Substring dedup by level-wise doubling of repeated word windows.

A ladder of window lengths doubles up to the wanted one (7 -> 13, or 7 -> 14 -> 28 -> 50). Only windows that repeat
at one length, in two documents, are extended to the next; the longest rung decides what goes. On the lowest rung a
window of the second length is represented by the smallest hash among the short windows in it (equal windows choose
equal ones), which sends about a quarter of the positions and loses nothing.

Spark's part: documents are dealt into groups of bounded size; each group sends each hash at most once (so a passage
that a third of all documents share costs a row a group, not a row an occurrence), one shuffle by hash finds what
repeats, and the answers go back to the groups. Below the last rung 64 bits tell windows apart (a false match there only extends a window in vain);
at the last rung, which decides, 96 bits do: two independent hashes of 64 and 32 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, covered, dealt, hash_words, ids_of, split_words, text_bytes, window_hashes, windows_inside

#: What groups send of a hash: below the last rung whether two ids here have it; at the last the smallest id and how far the largest lies off.
SENT, SENT_LAST = "h long, pid int, many boolean", "h long, pid int, lo long, span long, more int, clash boolean"


def ladder(window: int, base: int) -> list[int]:
    """Window lengths from base, each at most twice the last, to window."""
    rungs = [window]
    while rungs[0] > base:
        rungs.insert(0, (rungs[0] + 1) // 2)
    return rungs


#: The multiplier of the second hash.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class Group:
    """The words of one group of documents."""

    def __init__(self, table: pa.Table):
        self.ids = ids_of(table["doc_id"])
        self.words, self.first = split_words(*text_bytes(table["text"]))
        self.hashes = hash_words(self.words)
        self.n = len(self.hashes)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def thinned(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of length ``long`` (their positions) and for each the smallest hash among the ``short`` windows in it."""
        at = np.flatnonzero(windows_inside(self.first, long, self.n))
        if not len(at):
            return at, np.zeros(0, np.uint64)
        h = window_hashes(self.hashes, short)
        least = h[: self.n - long + 1].copy()
        for k in range(1, long - short + 1):
            np.minimum(least, h[k : k + len(least)], out=least)
        return at, least[at]

    def at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(windows_inside(self.first, length, self.n))
        return at, window_hashes(self.hashes, length)[at] if len(at) else np.zeros(0, np.uint64)

    def more(self, at: np.ndarray, length: int) -> np.ndarray:
        """32 further bits of the windows at some positions, from word hashes of their own."""
        if not len(at):
            return np.zeros(0, np.int32)
        again = hash_words(self.words, int(SECOND >> np.uint64(32)))
        return (window_hashes(again, length, SECOND)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def sent(self, at: np.ndarray, h: np.ndarray, pid: int, last: int = 0) -> pa.Table:
        """Each hash once; with 32 further bits of it where ``last``, the window length, is given, and whether these alone tell it from another one here."""
        owner, more = self.ids[self.doc[at]], self.more(at, last) if last else np.zeros(len(at), np.int32)
        order = np.lexsort((owner, more, h))
        h, more, owner = h[order], more[order], owner[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (more[1:] != more[:-1]))) if len(h) else np.zeros(0, np.int64)
        span = owner[np.append(new[1:], len(h)) - 1 if len(h) else new] - owner[new]
        out = {"h": h[new].view(np.int64), "pid": np.full(len(new), pid, np.int32)}
        if not last:
            return pa.table(out | {"many": span > 0})
        twice = h[new][1:] == h[new][:-1]
        return pa.table(out | {"lo": owner[new], "span": span, "more": more[new], "clash": (np.append(False, twice) | np.append(twice, False))[: len(new)]})


def known(table: pa.Table) -> np.ndarray:
    return np.sort(table["h"].to_numpy().view(np.uint64)) if table.num_rows else np.zeros(0, np.uint64)


def among(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h if len(of) else np.zeros(len(h), bool)


def repeated(sent: DataFrame, last: bool) -> DataFrame:
    """What groups must know: hashes that two documents have; at the last rung, where a later id than the first has it, with that first id (and the
    further bits only where the group needs them).

    A hash has one row a group, whatever the number of documents with it, and a window spills what it holds; a join with an aggregate in tables of
    their own would let Spark split the rows of one hash, but writes all windows twice more."""
    by = W.partitionBy("h")
    if last:
        by = W.partitionBy("h", "more")
        return sent.withColumn("lowest", F.min("lo").over(by)).where(F.col("lo") + F.col("span") > F.col("lowest")).select("pid", "h", F.when(F.col("clash"), F.col("more")).alias("more"), "lowest")
    return sent.withColumn("groups", F.count(F.lit(1)).over(by)).where("many or groups > 1").select("pid", "h")


def substring_dedup(docs: DataFrame, window: int = 13, base: int = 7, texts: bool = False) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text. Words are runs of bytes other than
    space and tab to carriage return. Null and empty texts, and texts of fewer words than a window, lose nothing (the hash
    of an empty text is that of no bytes). A null doc_id sorts after all ids. Rows with the same id are one document's
    parts: they never remove each other's words, so exact repeats of a row give equal rows. An empty table gives none."""
    rungs = ladder(window, base)
    groups = dealt(docs)
    if len(rungs) == 1:
        rungs = [window, window]

    def lowest(key, table):
        g = Group(table)
        return g.sent(*g.thinned(rungs[0], rungs[1]), key[0].as_py())

    answers = repeated(groups.groupBy("pid").applyInArrow(lowest, SENT), last=False)
    for k in range(1, len(rungs)):
        answers = repeated(groups.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_climb(rungs, k), SENT_LAST if k == len(rungs) - 1 else SENT), last=k == len(rungs) - 1)

    def cut(key, table, answer):
        g = Group(table)
        at, h = g.at(window)
        hit = np.zeros(len(at), bool)
        if answer.num_rows and len(at):
            known_h, low, clash = answer["h"].to_numpy().view(np.uint64), answer["lowest"].to_numpy(), answer["more"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            order = np.flatnonzero(~clash)[np.argsort(known_h[~clash])]
            if len(order):
                k = order[np.minimum(np.searchsorted(known_h[order], h), len(order) - 1)]
                hit = (known_h[k] == h) & (g.ids[g.doc[at]] > low[k])
            for k in np.flatnonzero(clash).tolist():  # windows that agree in 64 bits with others of the group
                same = np.flatnonzero(h == known_h[k])
                same = same[g.more(at[same], window) == answer["more"][k].as_py()]
                hit[same] = g.ids[g.doc[at[same]]] > low[k]
        gone = covered(at[hit], window, g.n)
        sizes = np.diff(np.frombuffer(g.words.buffers()[1], np.int64))
        data = np.frombuffer(g.words.buffers()[2], np.uint8) if g.n else np.zeros(0, np.uint8)
        keep = ~gone
        # kept words joined by one space: each word's bytes and a space after it
        width = (sizes[keep] + 1).astype(np.int64)
        ends = np.cumsum(width)
        flat = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        letter = np.ones(len(flat), bool)
        letter[ends - 1] = False
        flat[letter] = data[np.repeat(keep, sizes)]
        flat, upto = flat.tobytes(), np.append(0, np.cumsum(keep))[g.first]
        ends = np.append(0, ends)
        kept = [flat[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(upto, upto[1:], strict=False)]
        n = np.diff(g.first)
        ids = pa.array(g.ids, mask=g.ids == NULL_ID)
        out = {"doc_id": ids, "n_words": n.astype(np.int64), "n_removed": (n - np.diff(upto)).astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept_text": pa.array([x.decode() for x in kept], pa.string())} if texts else {}))

    return groups.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def _climb(rungs: list[int], k: int):
    """Sends the windows of rung k that are made of repeated ones of the rung below."""

    def climb(key, table, answer):
        g, pid = Group(table), (key[0].as_py())
        have = known(answer)
        at, h = g.at(rungs[k])
        if not len(have):
            at, h = at[:0], h[:0]
        elif k == 1:
            alive = among(g.thinned(rungs[0], rungs[1])[1], have)
            at, h = at[alive], h[alive]
        elif len(at):
            below = among(window_hashes(g.hashes, rungs[k - 1]), have)
            alive = below[at] & below[at + rungs[k] - rungs[k - 1]]
            at, h = at[alive], h[alive]
        return g.sent(at, h, pid, rungs[k] if k == len(rungs) - 1 else 0)

    return climb
