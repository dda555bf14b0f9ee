"""Suffix-array dedup: remove every byte of any long string that occurs more than once, in one document or in several.

Suffix arrays need equal strings in one shard. Each window of ``length`` bytes has an anchor: the smallest hash among the
short strings in it. Equal windows have equal anchors at equal places, so the windows of one anchor make a shard of their own, and a
segment (the windows in a row that share one anchor's place) is short. First only hashes travel: anchors that occur once are out, and of
segments that look alike two are sent, whatever their number. Suffix arrays, sorted by induction (induced_sort.py), and their permuted
common prefixes alone decide which windows repeat: in shards of the different segments of an anchor, byte by byte, and in shards of two
copies of one segment, eight bytes a symbol. A further copy shares the verdict of the two by a 128-bit digest; nothing goes that was not sorted.

An anchor with more than ``most`` different segments, such as those at the rim of a passage that very many documents share, is split by
further context: its windows are parted by how far left of the anchor they start, and all windows of a part share more bytes than the
anchor, whose digest makes the shard. Parts are split again until a shard is small; a part of one window has one content. Inside a task, shards
of more than ``FEW`` different texts are split the same way before they are sorted, so that many short shards are sorted in step."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, covered, dealt, group_count, ids_of, materialize, pieces, text_bytes, windows_inside
from loomnet.llm.induced_sort import common_prefixes, ragged, suffix_arrays

#: Length of the short strings that anchors are chosen from.
SHORT = 16
#: Symbols that one pass of induced sorting takes, and bytes in a symbol for copies of one segment.
PASS, WIDE = 1_000_000, 8
#: Different texts of a shard that are sorted together.
FEW = 8
#: Parts that the windows of a crowded anchor are split into at a time.
PARTS = 8
TWIN, MIXED, CROWDED = 0, 1, 2
#: Bytes of text that are hashed at once; small enough for a processor's cache.
BLOCK = 200_000
#: A unit is a stretch of text whose windows share an anchor. (c1, c2) is its shard, (d1, d2) its digest; (h, k1, k2) the segment it belongs
#: to, ``at`` its first window's place there, ``lead`` the anchor's place in it, ``answer`` whether its windows' repeats are asked for.
UNIT = "slot int, kind int, c1 long, c2 long, d1 long, d2 long, h long, k1 long, k2 long, at int, lead int, lo int, hi int, answer boolean, payload binary"
#: What sorting found: windows at .. at + count of a segment if runs is null, else those that runs lists.
MARK = "kind int, c1 long, c2 long, d1 long, d2 long, h long, k1 long, k2 long, at int, count int, runs binary"
SHARD, DIGEST, SEGMENT = ["c1", "c2"], ["c1", "c2", "d1", "d2"], ["h", "k1", "k2"]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row, in linear time: prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def digests(texts, seeds) -> np.ndarray:
    """128-bit digests as rows of two int64."""
    raw = b"".join([xxhash.xxh3_128_digest(t, s) for t, s in zip(texts, seeds, strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


class Segments:
    """The segments of some documents: runs of windows with one anchor each."""

    def __init__(self, table, length: int):
        self.ids = ids_of(table["doc_id"])
        self.data, self.first = text_bytes(table["text"])
        self.length, self.view = length, self.data.tobytes()
        parts = [self._segments(a, b) for a, b in _stretches(self.first, BLOCK)]
        self.begin, self.count, anchor = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3))
        self.lead = anchor - self.begin
        self.h = np.fromiter((xxhash.xxh3_64_intdigest(self.view[a : a + SHORT]) for a in anchor.tolist()), np.uint64, len(anchor)).view(np.int64)
        self.k = digests(map(self.text, range(len(anchor))), self.lead.tolist())

    def text(self, i: int) -> bytes:
        b = int(self.begin[i])
        return self.view[b : b + int(self.count[i]) + self.length - 1]

    def find(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(row, segment) for every segment that a row of the table names by h, k1, k2; rows ascending."""
        h, k1, k2 = (table[c].to_numpy() for c in SEGMENT)
        order = np.argsort(self.k[:, 0], kind="stable")
        low, high = (np.searchsorted(self.k[order, 0], k1, side) for side in ("left", "right"))
        row, own = np.repeat(np.arange(len(k1)), high - low), order[ragged(low, high)]
        same = (self.k[own, 1] == k2[row]) & (self.h[own] == h[row])
        return row[same], own[same]

    def _segments(self, a: int, b: int):
        """begin, count and anchor of the segments of documents a to b."""
        low, high = int(self.first[a]), int(self.first[b])
        first = self.first[a : b + 1] - low
        inside = np.flatnonzero(windows_inside(first, self.length, high - low))
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        h = self.data[low:high].astype(np.uint32) + np.uint32(0x9E3779B1)
        size = 1
        while size < SHORT:
            h = h[:-size] * np.uint32(pow(0x85EBCA6B, size, 2**32)) + h[size:]
            size *= 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        keys = (h ^ (h >> np.uint32(12))).astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
        anchor = (sliding_least(keys, self.length - SHORT + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)))
        return inside[new] + low, np.diff(np.append(new, len(inside))), anchor[new] + low


def _stretches(first: np.ndarray, size: int):
    """Runs of documents of about ``size`` bytes in all, one document at least."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + size, side="right")) - 1)
        yield a, b
        a = b


def _rows(schema: str, rows: list) -> pa.Table:
    """An Arrow table of rows, by a schema of int, long, boolean and binary columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _counted(each: DataFrame, most: int) -> DataFrame:
    """Shards with more than one occurrence in all: their digests with how many occurrences (times) each has and how many digests (kinds) the shard."""
    # a table of its own, so that the join is of two plain shuffles, whose hot keys Spark can split
    shards = materialize(each.groupBy(*SHARD).agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1").drop("total"), "shards")
    known = each.join(shards, SHARD).withColumn("twin", F.col("times") > 1)
    known = known.withColumn("group", F.when(F.col("kinds") == 1, -1).when(F.col("kinds") <= most, MIXED).otherwise(CROWDED))
    return materialize(known.where("twin or kinds > 1").select(*DIGEST, "twin", "group", "low", "high"), "digests")


def suffix_dedup(docs: DataFrame, length: int = 400, most: int = 512, texts: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else; strings never cross documents.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes. Null and empty texts and those
    shorter than ``length`` lose nothing. Rows are judged as given: identical rows are copies of each other and lose all
    that is long enough, also when they share an id; a null doc_id is kept as null. An empty table gives none. ``most`` bounds the segments
    of a shard and has no say in what is found."""
    rows = dealt(docs, mb=3)
    shards = group_count(docs, mb=3)

    def anchors(batches):
        for batch in pieces(batches, "text", 3_000_000):
            s = Segments(batch, length)
            pid = batch.column("pid").to_numpy()[np.searchsorted(s.first, s.begin, side="right") - 1]
            order = np.lexsort((pid, s.k[:, 1], s.k[:, 0], s.h))
            columns = [s.h[order], s.k[order, 0], s.k[order, 1], pid[order]]
            new = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(order) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[new]) for c in columns), pa.array(np.diff(np.append(new, len(order))))], names=[*SEGMENT, "pid", "n"])

    sent = materialize(rows.mapInArrow(anchors, "h long, k1 long, k2 long, pid int, n long"), "anchors")
    each = sent.groupBy(*SEGMENT).agg(F.sum("n").alias("times"), F.min("pid").alias("low"), F.max("pid").alias("high"))
    known = _counted(each.select(F.col("h").alias("c1"), F.lit(0).cast("long").alias("c2"), F.col("k1").alias("d1"), F.col("k2").alias("d2"), "times", "low", "high"), most)
    asked = known.select(
        F.explode(F.when(F.col("twin") & (F.col("low") != F.col("high")), F.array("low", "high")).otherwise(F.array("low"))).alias("pid"),
        F.col("c1").alias("h"), F.col("d1").alias("k1"), F.col("d2").alias("k2"), "twin", "group", "low", "high",
    )
    asked = asked.select("pid", *SEGMENT, F.when(F.col("twin"), F.when(F.col("low") == F.col("high"), 2).otherwise(1)).otherwise(0).alias("copies"), F.when(F.col("pid") == F.col("low"), F.col("group")).otherwise(-1).alias("group"), (~F.col("twin")).alias("answer"))
    groups = rows.groupBy("pid")

    def units(crowded: bool):
        def emit(key, table, ask):
            s, out = Segments(table, length), []
            if ask.num_rows and len(s.h):
                row, own = s.find(ask)
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                last = np.append(first[1:], len(row)) - 1
                copies, group, answer = (ask[c].to_numpy(zero_copy_only=False) for c in ("copies", "group", "answer"))
                for r, a, b in zip(row[first].tolist(), own[first].tolist(), own[last].tolist() if len(row) else [], strict=True):
                    h, k1, k2 = int(s.h[a]), int(s.k[a, 0]), int(s.k[a, 1])
                    kinds = [(group[r], h, a)] if crowded else [(MIXED, h, a)] * int(group[r] == MIXED) + [(TWIN, k1, a)] * int(copies[r] > 0) + [(TWIN, k1, b)] * int(copies[r] > 1)
                    out += [(to % shards, kind, h, 0, k1, k2, h, k1, k2, 0, int(s.lead[i]), 0, length - SHORT + 1, bool(answer[r]), s.text(i)) for kind, to, i in kinds]
            return _rows(UNIT, out)

        return emit

    def sort_shard(key, table):
        return _rows(MARK, list(_sorted(table, length)))

    sorted_ = groups.cogroup(asked.where(f"copies > 0 or `group` = {MIXED}").groupBy("pid")).applyInArrow(units(False), UNIT).groupBy("slot").applyInArrow(sort_shard, MARK)
    marks = sorted_.select(*SEGMENT, "at", "count", "runs")
    crowded = asked.where(f"`group` = {CROWDED}")
    if crowded.limit(1).count():
        for found in _split(groups.cogroup(crowded.groupBy("pid")).applyInArrow(units(True), UNIT), length, most, shards, sort_shard):
            marks = marks.unionByName(found)
    answers = sent.select(*SEGMENT, "pid").join(marks, SEGMENT)

    def cut(key, table, answer):
        s = Segments(table, length)
        n = len(s.data)
        hits = [np.zeros(0, np.int64)]
        if answer.num_rows and len(s.h):
            row, own = s.find(answer)
            at, count, runs = answer["at"].to_numpy(), answer["count"].to_numpy(), answer["runs"].combine_chunks()
            whole = ~runs.is_valid().to_numpy(zero_copy_only=False)[row]
            begin = s.begin[own[whole]] + at[row[whole]]
            hits.append(ragged(begin, begin + count[row[whole]]))
            hits += [s.begin[i] + np.frombuffer(runs[r].as_buffer(), np.int32) for r, i in zip(row[~whole].tolist(), own[~whole].tolist(), strict=True)]
        gone = covered(np.unique(np.concatenate(hits)), length, n)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begins = s.first[:-1][s.first[:-1] < n]
        opens[begins] = gone[begins]
        upto, spans = np.append(0, np.cumsum(gone))[s.first], np.append(0, np.cumsum(opens))[s.first]
        flat = s.data[~gone].tobytes()
        ends = s.first - upto
        kept = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        out = {"doc_id": pa.array(s.ids, mask=s.ids == NULL_ID), "n_bytes": np.diff(s.first), "n_removed": np.diff(upto), "n_spans": np.diff(spans), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept_bytes": pa.array(kept, pa.binary())} if texts else {}))

    return groups.cogroup(answers.groupBy("pid")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * texts)


def _parts(at: int, lead: int, lo: int, hi: int, payload: bytes, length: int):
    """The parts of a unit: (lo, hi, first window, windows, lead, shared bytes). Windows that start lo .. hi - 1 bytes left of the anchor are parted by that."""
    windows, step = len(payload) - length + 1, -(-(hi - lo) // PARTS)
    for low in range(lo, hi, step):
        high = min(low + step, hi)
        a, b = max(0, lead - high + 1), min(windows, lead - low + 1)
        if a < b:
            yield low, high, a, b - a, lead - a, payload[lead - low : lead - high + 1 + length]


def _split(crowded: DataFrame, length: int, most: int, shards: int, sort_shard) -> list[DataFrame]:
    """The marks of crowded anchors. Every round splits the units of crowded shards and sorts the shards that are small by then; a part
    of one window is never crowded, so there are as many rounds as it takes to come from all windows of a segment to one, a factor PARTS at a time."""
    own = [*SEGMENT, "at", "lead", "lo", "hi", "answer", "payload"]
    numbered = lambda df: materialize(df.select(F.monotonically_increasing_id().alias("uid"), *own), "crowded")
    units, found = numbered(crowded), []
    tasks = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def children(batches):
        for batch in pieces(batches, "payload"):
            out, texts, seeds, shared, lows = [], [], [], [], []
            for r in batch.to_pylist():
                for low, high, a, count, lead, common in _parts(*(r[c] for c in ("at", "lead", "lo", "hi", "payload")), length):
                    out.append((r["uid"], *(r[c] for c in SEGMENT), r["at"] + a, count, r["answer"], low))
                    texts.append(r["payload"][a : a + count + length - 1])
                    seeds.append(lead)
                    shared.append(common)
                    lows.append(low)
            c, d = digests(shared, lows), digests(texts, seeds)
            table = _rows("uid long, h long, k1 long, k2 long, at int, count int, answer boolean, lo int", out)
            for name, column in (("c1", c[:, 0]), ("c2", c[:, 1]), ("d1", d[:, 0]), ("d2", d[:, 1])):
                table = table.append_column(name, pa.array(column))
            yield from table.to_batches()

    def cut(batches):
        for batch in pieces(batches, "payload"):
            out = []
            for r in batch.to_pylist():
                wanted = {w["lo"]: w for w in r["wanted"]}
                for low, high, a, count, lead, _ in _parts(*(r[c] for c in ("at", "lead", "lo", "hi", "payload")), length):
                    if low in wanted:
                        w = wanted[low]
                        for kind, to in [(TWIN, w["d1"])] * w["copy"] + [(w["group"], w["c1"])] * (w["group"] >= 0):
                            out.append((to % shards, kind, *(w[c] for c in DIGEST), *(r[c] for c in SEGMENT), r["at"] + a, lead, low, high, r["answer"] and not w["twin"], r["payload"][a : a + count + length - 1]))
            yield from _rows(UNIT, out).to_batches()

    while True:
        small = materialize(units.mapInArrow(children, "uid long, h long, k1 long, k2 long, at int, count int, answer boolean, lo int, c1 long, c2 long, d1 long, d2 long"), "parts")
        known = _counted(small.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("times"), F.min("uid").alias("low"), F.max("uid").alias("high")), most)
        alive = small.join(known, DIGEST)
        first, ends = F.col("uid") == F.col("low"), (F.col("uid") == F.col("low")) | (F.col("uid") == F.col("high"))
        wanted = alive.select("uid", "lo", *DIGEST, "twin", (F.col("twin") & ends).cast("int").alias("copy"), F.when(first, F.col("group")).otherwise(-1).alias("group")).where("copy > 0 or `group` >= 0")
        wanted = wanted.groupBy("uid").agg(F.collect_list(F.struct("lo", *DIGEST, "twin", "copy", "group")).alias("wanted"))  # PARTS at most
        parts = materialize(units.join(wanted, "uid").select("uid", *own, "wanted").mapInArrow(cut, UNIT), "units")
        # dealt by number: the parts are few bytes but much work, and Spark would put small partitions together into one task
        marks = materialize(parts.where(F.col("kind") != CROWDED).repartition(tasks, "slot").groupBy("slot").applyInArrow(sort_shard, MARK), "marks")
        whole = marks.where(F.col("kind") == TWIN).select(*DIGEST).distinct()
        found.append(alive.where("answer").join(whole, DIGEST).select(*SEGMENT, "at", "count", F.lit(None).cast("binary").alias("runs")))
        found.append(marks.where(F.col("kind") == MIXED).select(*SEGMENT, "at", "count", "runs"))
        units = numbered(parts.where(F.col("kind") == CROWDED))
        if not units.limit(1).count():
            return found


# --- inside a shard ----------------------------------------------------------


def _sorted(table: pa.Table, length: int):
    """The rows of MARK for the units of a slot."""
    names = [*DIGEST, *SEGMENT, "at", "lead", "answer"]
    columns = {c: table[c].to_pylist() for c in names}
    payload, kinds = table["payload"].combine_chunks(), table["kind"].to_numpy()
    key = [list(zip(*(columns[c] for c in by), strict=True)) for by in (DIGEST, SHARD)]
    mark = lambda kind, i, at, count, runs: (kind, *(columns[c][i] for c in (*DIGEST, *SEGMENT)), at, count, runs)

    twins: dict = {}
    for i in np.flatnonzero(kinds == TWIN).tolist():
        twins.setdefault(key[0][i], []).append(i)
    pairs = [v[:2] for v in twins.values() if len(v) > 1]
    for some in _passes(((pair, [payload[i].as_py() for i in pair]) for pair in pairs), WIDE):
        for pair, text, same in _wide(some, length):
            if same:
                yield mark(TWIN, pair[0], 0, len(text) - length + 1, None)

    mixed: dict = {}
    for i in np.flatnonzero(kinds == MIXED).tolist():
        mixed.setdefault(key[1][i], []).append(i)
    ranges = zip(table["lo"].to_pylist(), table["hi"].to_pylist(), strict=True)
    ranges = list(ranges)
    small = (shard for rows in mixed.values() for shard in _small([([(i, 0)], columns["lead"][i], payload[i].as_py()) for i in rows], *ranges[rows[0]], length))
    starts: dict = {}
    for some in _passes(small, 1):
        for members, hit in _narrow(some, length):
            for i, offset in members:
                if columns["answer"][i]:
                    starts.setdefault(i, []).append(hit + (offset + columns["at"][i]))
    for i, hits in starts.items():
        yield mark(MIXED, i, 0, 0, np.unique(np.concatenate(hits)).astype(np.int32).tobytes())


def _agree(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _reach(texts: list[bytes]) -> list[int]:
    """How much of each text some other one agrees with from the start: with a neighbour in sorted order."""
    order, out = sorted(range(len(texts)), key=texts.__getitem__), [0] * len(texts)
    for a, b in zip(order, order[1:], strict=False):
        n = _agree(texts[a], texts[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def _small(units: list, lo: int, hi: int, length: int):
    """Shards of few different texts from the units of one shard, each ([(row, offset)], lead, text), whose windows start lo .. hi - 1 bytes left of the anchor.

    Units are cut down to what others agree with on either side of the anchor: a repeated window lies within, so the rest can't matter, nor can a
    unit with less than ``length`` bytes of that. Of equal texts two copies stay. What are still many texts is split by further context."""
    right = _reach([t[lead:] for _, lead, t in units])
    left = _reach([t[:lead][::-1] for _, lead, t in units])
    same: dict = {}
    for (members, lead, t), x, y in zip(units, left, right, strict=True):
        if len(members) > 1:
            x, y = lead, len(t) - lead  # its own copies agree with all of it
        if x + y >= length:
            same.setdefault((x, t[lead - x : lead + y]), []).extend((i, offset + lead - x) for i, offset in members)
    if len(same) <= FEW:
        if sum(map(len, same.values())) > 1:
            copies = [(members, t) for (_, t), members in same.items() for _ in members[:2]]
            yield [members if k == 0 or copies[k - 1][0] is not members else [] for k, (members, _) in enumerate(copies)], [t for _, t in copies]
        return
    parts: dict = {}
    for (lead, t), members in same.items():
        for low, high, a, count, own, common in _parts(0, lead, lo, hi, t, length):
            parts.setdefault((low, high, common), []).append(([(i, offset + a) for i, offset in members], own, t[a : a + count + length - 1]))
    for (low, high, _), some in parts.items():
        if len(some) > 1 or len(some[0][0]) > 1:
            yield from _small(some * 2 if len(some) == 1 else some, low, high, length)


def _passes(shards, wide: int):
    """Lists of shards, longest first, about PASS symbols in a list."""
    sized = sorted(((sum(-(-len(t) // wide) + 1 for t in texts) + 1, k, (what, texts)) for k, (what, texts) in enumerate(shards)), reverse=True)
    out, total = [], 0
    for size, _, shard in sized:
        out.append((size, *shard))
        total += size
        if total >= PASS:
            yield out
            out, total = [], 0
    if out:
        yield out


def _prefixes(some: list, wide: int, least: int, most: int):
    """Sort the shards of a pass; (shard, unit, begin, end) of every unit in the text and the permuted common prefixes, in symbols."""
    starts = np.append(0, np.cumsum([size for size, _, _ in some]))
    text, bounds = np.zeros(starts[-1], np.int64), []  # 0 ends a shard, 1 a unit
    letters = np.zeros(starts[-1], np.uint64)
    for k, (at, (_, _, texts)) in enumerate(zip(starts.tolist(), some, strict=False)):
        for u, t in enumerate(texts):
            n = -(-len(t) // wide)
            letters[at : at + n] = np.frombuffer(t.ljust(n * wide, b"\0"), np.uint64 if wide == 8 else np.uint8)
            text[at : at + n] = 2
            text[at + n] = 1
            bounds.append((k, u, at, at + n))
            at += n + 1
    if wide == 1:
        text += letters.astype(np.int64)
    else:  # number the symbols of each shard
        inside = np.flatnonzero(text == 2)
        shard = np.searchsorted(starts, inside, side="right")
        order = np.lexsort((letters[inside], shard))
        s, w = shard[order], letters[inside][order]
        fresh = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        number = np.cumsum(np.append(0, (w[1:] != w[:-1]) | fresh[1:])) if len(s) else np.zeros(0, np.int64)
        text[inside[order]] = 2 + number - number[np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))]
    return bounds, common_prefixes(text, starts, suffix_arrays(text, starts), least, most)


def _wide(some: list, length: int):
    """(rows, text, whether all its windows repeat) for pairs that should be copies. Copies agree in step, so every WIDE bytes a suffix
    is enough: what a suffix shares with its neighbour, the places up to the next one share but for the bytes between."""
    bounds, shared = _prefixes(some, WIDE, length // WIDE, length // WIDE + 2)
    for k, u, a, _ in bounds:
        if u == 0:
            _, pair, (text, other) = some[k]
            p = np.arange(max(0, len(text) - length + 1))
            need = (p % WIDE + length + WIDE - 1) // WIDE
            yield pair, text, len(text) == len(other) and bool((shared[a + p // WIDE] >= need).all())


def _narrow(some: list, length: int):
    """(members, places of repeated windows) for the texts of shards."""
    bounds, shared = _prefixes(some, 1, length, length)
    for k, u, a, b in bounds:
        members = some[k][1][u]
        hit = np.flatnonzero(shared[a : b - length + 1] >= length)
        if len(hit) and members:
            yield members, hit
