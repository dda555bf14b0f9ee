"""Spelling variants: words that differ by one code point, found through the parity of their letters.

A word's mask has one bit for each letter of the alphabet, set where the letter occurs an odd number of times. One inserted or deleted letter flips one bit and one
replaced letter two, so of a mask's three bands at least one stays as it is. Words with an equal band meet in a bucket together with those of their own length or one more,
and a pair of a bucket goes on if its masks differ in at most two bits and is then compared letter by letter.

Buckets are bounded: one of more than ``LARGE`` words is not compared pair by pair. Its words are written once for each of their letters, without that letter, by
Spark; what is equal then (same place for words of one length) is near by construction, so such rows grow with the words and not with pairs."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, as_bytes, bounded_batches, ids_of, materialize, pieces, split_words, text_bytes

#: Words of a bucket that are compared pair by pair, rows of a task that compares buckets, and pairs it looks at at once.
LARGE, ROWS, PAIRS = 1024, 60_000, 2_000_000
BANDS = 3
#: Bytes of the letters: A-Z and a-z; U+00C0 to U+00FF are written as C3 and one more byte.
LATIN, ACCENTED = np.zeros(256, bool), 0xC3
LATIN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Only NUL parts words, once all that isn't a letter is written as NUL.
GAP = np.arange(256) == 0
#: Of a code point the number of its letter: a to z, then U+00C0 to U+00FF. Letters go to the bands in turn.
LETTER = np.zeros(0x100, np.int64)
LETTER[0x61:0x7B], LETTER[0xC0:0x100] = np.arange(26), np.arange(26, 90)
#: Longest run, in bytes, whose checksum is joined from those of its two parts by table.
BY_TABLE = 64
_SHIFTS: dict[int, np.ndarray] = {}


# --- words ---------------------------------------------------------------------------


def _shift(length: int) -> np.ndarray:
    """Four tables of 256 that say what a CRC-32 of some bytes becomes, byte by byte of it, if ``length`` bytes follow."""
    if length not in _SHIFTS:
        zeros = bytes(length)
        still = zlib.crc32(zeros, 0)
        bits = np.array([zlib.crc32(zeros, 1 << k) ^ still for k in range(32)], np.uint32).reshape(4, 8)
        low = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
        _SHIFTS[length] = np.stack([np.bitwise_xor.reduce(np.where(low, b, np.uint32(0)), axis=1) for b in bits])
    return _SHIFTS[length]


def checksums(prefixes: list[bytes], words: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The CRC-32 of prefixes[a[i]] + words[b[i]] for every i. A CRC is linear, so that of two parts in a row comes from those of the parts."""
    head = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))[a]
    tail = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[b]
    size = np.fromiter(map(len, words), np.int64, len(words))[b]
    out = np.zeros(len(a), np.uint32)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        if length > BY_TABLE:
            out[at] = [zlib.crc32(words[w], zlib.crc32(prefixes[p])) for p, w in zip(a[at].tolist(), b[at].tolist(), strict=True)]
            continue
        table, x = _shift(int(length)), head[at]
        out[at] = table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24] ^ tail[at]
    return out


def letter_runs(data: np.ndarray, first: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All runs of letters of texts in a row, with A-Z in lower case, and for each text its first one (one more than texts)."""
    lead = data == ACCENTED
    inside = LATIN[data] | lead
    inside[1:] |= lead[:-1]
    upper = (data >= 0x41) & (data <= 0x5A)
    return split_words(np.where(inside, data + (upper * np.uint8(32)), np.uint8(0)), first, breaks=GAP)


def count_words(docs: DataFrame, least: int, damage: int) -> DataFrame:
    """(word, n): the words of all texts with at least ``least`` code points, counted; ``damage`` as in spelling_variants()."""

    def run(batches):
        for batch in pieces(batches, "text", 4_000_000):
            prefixes = [b":" if k == NULL_ID else b"%d:" % k for k in ids_of(batch.column("doc_id")).tolist()]
            runs, of = letter_runs(*text_bytes(batch.column("text")))
            if not len(runs):
                continue
            coded = runs.dictionary_encode()
            points = pc.utf8_length(coded.dictionary.cast(pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(prefixes)), np.diff(of))
            long = points[code] >= least
            pair, times = np.unique(doc[long] * len(points) + code[long], return_counts=True)
            doc, code = pair // len(points), pair % len(points)
            words = as_bytes(coded.dictionary)
            counted: dict[str, int] = {}
            if damage and len(pair):
                h = checksums(prefixes, words, doc, code)
                hit = h % damage == 0
                for c, x, n in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
                    word = words[c].decode()
                    at = x % len(word)
                    if len(word) > least:
                        word = word[:at] + word[at + 1 :]
                        counted[word] = counted.get(word, 0) + n
                code, times = code[~hit], times[~hit]
            n = np.bincount(code, times, len(words)).astype(np.int64)
            there = np.flatnonzero(n)
            out = [words[k].decode() for k in there.tolist()] + list(counted)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(np.append(n[there], np.array(list(counted.values()), np.int64)))], names=["word", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- near words -------------------------------------------------------------------------


def masks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The length of each word (none is empty) and the three bands of its mask."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.append(0, np.cumsum(size))[:-1]
    letter = LETTER[points]
    bit = np.int64(1) << (letter // BANDS)
    return size, np.stack([np.bitwise_xor.reduceat(np.where(letter % BANDS == k, bit, 0), begins) for k in range(BANDS)]) if len(words) else np.zeros((BANDS, 0), np.int64)


def _with_masks(batches):
    for batch in batches:
        size, bands = masks(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(size), *map(pa.array, bands)], names=["word", "n", "size", *(f"m{k}" for k in range(BANDS))])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _compare(key, table):
    """Near words of whole buckets: pairs of neighbours at a distance of one, then two, and so on, in the order of buckets."""
    band, value, short, size = (table[c].to_numpy() for c in ("band", "value", "short", "size"))
    bands = np.stack([table[f"m{k}"].to_numpy() for k in range(BANDS)])
    order = np.lexsort((value, short, band))
    band, value, short, size, bands = band[order], value[order], short[order], size[order], bands[:, order]
    begins = np.append(True, (np.diff(band) != 0) | (np.diff(value) != 0) | (np.diff(short) != 0))
    left = np.append(np.flatnonzero(begins)[1:], len(band))[np.cumsum(begins) - 1] - np.arange(len(band)) - 1  # rows of the bucket behind each
    found = []
    for step in range(1, int(left.max(initial=0)) + 1):
        those = np.flatnonzero(left >= step)
        for a in np.array_split(those, -(-len(those) // PAIRS)):
            b = a + step
            ok = (size[a] == short[a]) | (size[b] == short[a])  # two of the longer kind meet in a bucket of their own
            ok &= np.bitwise_count(bands[:, a] ^ bands[:, b]).sum(0) <= 2
            for k in range(1, BANDS):  # only the first band that agrees speaks for a pair
                ok &= (band[a] != k) | (bands[:k, a] != bands[:k, b]).all(0)
            found.append((a[ok], b[ok]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    word, n = table["word"].take(pa.array(order)), table["n"].take(pa.array(order))
    left_, right = word.take(pa.array(a)).to_pylist(), word.take(pa.array(b)).to_pylist()
    near = np.array([one_edit(x, y) for x, y in zip(left_, right, strict=True)], bool)
    a, b = pa.array(a[near]), pa.array(b[near])
    return pa.table({"word": word.take(a), "n": n.take(a), "near": word.take(b), "near_n": n.take(b)})


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n, near, near_n: for the words of a table (word, n) without repeats every pair that is one edit apart, once, in either order."""
    masked = materialize(words.mapInArrow(_with_masks, "word string, n long, size long, " + ", ".join(f"m{k} long" for k in range(BANDS))), "masks")
    place = [F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("value"), (F.col("size") - longer).alias("short")) for k in range(BANDS) for longer in (0, 1)]
    key = ["band", "value", "short"]
    members = masked.withColumn("at", F.explode(F.array(*place))).select("*", "at.*").drop("at")
    crowded = members.groupBy(*key).count().where(F.col("count") > large).select(*key, F.lit(True).alias("crowded")).hint("merge")
    placed = materialize(members.join(crowded, key, "left"), "buckets")
    groups = max(1, -(-placed.count() // ROWS))
    few = placed.where(F.col("crowded").isNull()).withColumn("g", F.pmod(F.xxhash64(*key), F.lit(groups)))
    pair = "word string, n long, near string, near_n long"
    pairs = few.groupBy("g").applyInArrow(_compare, pair)
    # crowded buckets: equal without one letter
    many = placed.where("crowded").select("word", "n", "size", "short").distinct()
    each = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))))
    rest = F.concat(F.expr("substring(word, 1, k - 1)"), F.expr("substring(word, k + 1)"))
    each = each.withColumn("h", F.xxhash64(rest))
    spot = ["short", "k", "h"]
    same = each.where(F.col("size") == F.col("short"))
    replaced = same.join(same.select(*spot, F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), spot).where(F.col("word") < F.col("near"))
    whole = many.where(F.col("size") == F.col("short")).select("short", F.xxhash64("word").alias("h"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    inserted = each.where(F.col("size") > F.col("short")).join(whole.hint("merge"), ["short", "h"])
    columns = ["word", "n", "near", "near_n"]
    sure = replaced.select(*columns).union(inserted.select(*columns)).where(F.levenshtein("word", "near") == 1)
    ordered = lambda df: df.select(*(F.when(F.col("word") < F.col("near"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(columns, columns[2:] + columns[:2], strict=True)))
    return ordered(pairs.union(sure)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: for a table (word, form) without loops the last form of each chain. Every round jumps twice as far."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, damage: int = 0, large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with at least ``least`` code points and ``occurrences`` (n), how many words are one edit away
    (n_near), the most frequent of those (form; ties go to the smallest in code-point order) if it occurs at least ``times`` as often, with its count (form_n), and where
    forms lead in the end (root, the word itself if it has no form).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. ``damage`` above 0 plants misspellings: a run of a document whose CRC-32 of
    ``<doc_id>:<run>`` it divides loses one code point (without a doc_id: of ``:<run>``). Null and empty texts have no words, repeated rows count again, texts and words may be of any length, an
    empty table gives no rows. A form is at least ``times`` (2 or more) as frequent as its word, so chains are short and have no loops."""
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = materialize(count_words(docs, least, damage).where(F.col("n") >= occurrences), "words")
    pairs = materialize(near_words(words, large), "near")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    rows = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    last = roots(rows.where(F.col("form").isNotNull())).hint("merge")
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
