"""Token ids in binary shards with a minimal perfect hash index.

Layout of a store, in one folder of the shared file system:
  shards/shard-<k>.bin   8 bytes "LOOMIDS1", then raw little-endian ids (2 bytes each if the vocabulary allows, else 4), documents in ascending doc_id order
  index/bucket-<k>.mph   a minimal perfect hash of the document keys of one bucket, and per slot a fingerprint, shard, offset and length
A key is (doc_id, which of the rows with that id). Lookups are constant-time: hash to a bucket, a few bit tests and a rank, one slot.
Files are written under a name of their own and then renamed, so a task that is run again leaves the same files."""

from __future__ import annotations

import io
import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, after_letters, as_bytes, bounded_batches, group_count, ids_of, kinds_without, materialize, mix, pieces, shared_path, text_bytes

MAGIC = b"LOOMIDS1"
BUCKET_KEYS = 200_000
#: Most chunks whose ids a Python worker remembers.
REMEMBER = 250_000
_ENCODERS: dict = {}


def write_file(uri: str, data: bytes) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def read_file(uri: str) -> bytes:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


# --- minimal perfect hash ---------------------------------------------------


def _spread(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys: levels of bit sets; a key sits at the first level where it had a bit alone."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.ranks = [np.append(0, np.cumsum(np.bitwise_count(b).astype(np.int64))) for b in bits]
        self.before = np.append(0, np.cumsum([r[-1] for r in self.ranks]))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, level = [], 0
        while len(keys):
            size = 64 * (len(keys) * 3 // 2 // 64 + 1)
            at = _spread(keys, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
            level += 1
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not there any slot, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = _spread(keys[todo], level) % np.uint64(64 * len(bits))
            word, bit = (at // np.uint64(64)).astype(np.int64), at % np.uint64(64)
            hit = (bits[word] >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.before[level] + self.ranks[level][word] + below)[hit]
            todo = todo[~hit]
        return out


def key_hash(doc_id: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(nth.astype(np.uint64) + np.uint64(1)))


def build_index(doc_id, nth, shard, offset, length) -> bytes:
    keys = key_hash(doc_id, nth)
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    out = {"print": (mix(keys) >> np.uint64(32)).astype(np.uint32), "shard": shard.astype(np.uint32), "offset": offset.astype(np.uint64), "length": length.astype(np.uint64)}
    for k, v in out.items():
        placed = np.empty_like(v)
        placed[slot] = v
        out[k] = placed
    buffer = io.BytesIO()
    np.savez(buffer, **out, **{f"bits{i}": b for i, b in enumerate(mph.bits)})
    return buffer.getvalue()


def look_up(index: bytes, doc_id: np.ndarray, nth: np.ndarray) -> dict[str, np.ndarray]:
    """found, shard, offset and length for each key; found is whether the stored fingerprint agrees."""
    with np.load(io.BytesIO(index)) as x:
        table = {k: x[k] for k in ("print", "shard", "offset", "length")}
        mph = PerfectHash([x[f"bits{i}"] for i in range(sum(k.startswith("bits") for k in x.files))])
    keys = key_hash(doc_id, nth)
    slot = mph.slots(keys)
    found = slot >= 0
    found[found] = table["print"][slot[found]] == (mix(keys[found]) >> np.uint64(32)).astype(np.uint32)
    return {"found": found} | {k: table[k][np.maximum(slot, 0)] for k in ("shard", "offset", "length")}


# --- encoding ------------------------------------------------------------------


class Memory:
    """What was computed last, in two generations of at most ``limit`` entries each: when the young one is full it becomes the old one, and what
    is asked for again moves back to the young one, so frequent entries stay."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self[key] = value
        return value

    def __setitem__(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each different chunk once.

    A text is cut where the usual word pattern of byte-level tokenizers always ends a match: before a single space with no white space beside
    it (a space can only begin a match there), between an ASCII letter and ASCII punctuation, and around a line feed that stands alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(REMEMBER)
        self.kind = kinds_without(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __call__(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        chunks, of = _chunks(data, first, self.kind)
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(first) - 1, np.int64)
        coded = chunks.dictionary_encode()
        different = as_bytes(coded.dictionary)
        each = list(map(self.known.get, different))
        new = [k for k, ids in enumerate(each) if ids is None]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([different[k].decode() for k in part], add_special_tokens=False), strict=True):
                each[k] = self.known[different[k]] = array("I", e.ids).tobytes()
        ids, counts = gather(each, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(np.append(0, np.cumsum(counts))[of])


def gather(each: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in each[i] (four bytes an id) for i in index, in a row; and how many each has."""
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat, begins = np.frombuffer(b"".join(each), np.uint32), np.append(0, np.cumsum(sizes))[:-1]
    counts = sizes[index]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[index] - (ends - counts), counts)], counts


def _chunks(data: np.ndarray, first: np.ndarray, kind: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        ascii_space = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))
        wide = (data == 0xE1) | (data == 0xE2) | (data == 0xE3)  # lead bytes of white space beyond ASCII, with C2
        before = ascii_space.copy()
        before[1:] |= data[:-1] == 0xC2
        before[2:] |= wide[:-2]
        after = ascii_space | wide | (data == 0xC2)
        alone = ~before[:-2] & ~after[2:]
        cut[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & alone
        cut[2:] |= (data[1:-1] == 0x0A) & alone
        cut |= after_letters(data, kind)
    begins = first[:-1]
    cut[begins[begins < n]] = True
    starts = np.flatnonzero(cut)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)])
    return chunks, np.searchsorted(starts, first)


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


# --- the store ---------------------------------------------------------------------


def write_store(docs: DataFrame, path: str, uri: str | None = None, end_id: int = 0) -> tuple[str, DataFrame]:
    """Encode every text, append ``end_id`` to each, and write the shards and the index; the store's folder and its directory.

    The directory is a table (doc_id, nth, shard, offset, length), written as Parquet beside the shards. A null text is empty and has only
    the end id; a null doc_id comes last; rows with one id are told apart by nth, in the order of their texts."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    uri = uri or shared_path(spark, "tokens")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = keyed.repartitionByRange(group_count(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write_shard(batches):
        shard, encode = TaskContext.get().partitionId(), encoder(path)
        size = 2 if encode.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        payload, at, last, nth = [], 0, None, 0
        for batch in pieces(batches, "text", 6_000_000):
            keys = ids_of(batch.column("doc_id"))
            ids, counts = encode(*text_bytes(batch.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            counts = counts + 1
            payload.append(ids.astype(f"<u{size}").tobytes())
            order = np.zeros(len(keys), np.int32)
            for k, key in enumerate(keys.tolist()):
                nth = nth + 1 if key == last else 0
                last, order[k] = key, nth
            offsets = at + np.append(0, np.cumsum(counts))[:-1]
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(order), pa.array(np.full(len(keys), shard, np.int32)), pa.array(offsets), pa.array(counts), pa.array(np.full(len(keys), size, np.int32))], names=["doc_id", "nth", "shard", "offset", "length", "width"])
        if payload:
            write_file(f"{uri}/shards/shard-{shard:06d}.bin", b"".join([MAGIC, *payload]))

    dealt.mapInArrow(write_shard, "doc_id long, nth int, shard int, offset long, length long, width int").write.parquet(f"{uri}/directory")
    directory = spark.read.parquet(f"{uri}/directory")
    buckets = max(1, -(-directory.count() // BUCKET_KEYS))

    def write_index(key, table):
        bucket = key[0].as_py()
        index = build_index(*(table[c].to_numpy() for c in ("doc_id", "nth", "shard", "offset", "length")))
        write_file(f"{uri}/index/bucket-{bucket:06d}.mph", index)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([table.num_rows], pa.int64())})

    directory.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(write_index, "bucket int, keys long").write.parquet(f"{uri}/buckets")
    return uri, directory


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)).cast("int")


def locate(keys: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Where the store has each key (doc_id, nth): shard, offset, length, by its index alone; keys it doesn't have are left out."""

    def find(key, table):
        bucket = key[0].as_py()
        doc_id, nth = table["doc_id"].to_numpy(), table["nth"].to_numpy()
        hit = look_up(read_file(f"{uri}/index/bucket-{bucket:06d}.mph"), doc_id, nth)
        ok = hit["found"]
        return pa.table({"doc_id": doc_id[ok], "nth": nth[ok], "shard": hit["shard"][ok].astype(np.int32), "offset": hit["offset"][ok].astype(np.int64), "length": hit["length"][ok].astype(np.int64)})

    return keys.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(find, "doc_id long, nth int, shard int, offset long, length long")


def read_back(uri: str, width: int, located: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, nth, shard, offset, n_tokens, ids_crc32 and, if asked for, ids of located documents, from the shards' payloads."""

    def read(key, table):
        raw = read_file(f"{uri}/shards/shard-{key[0].as_py():06d}.bin")
        if raw[:8] != MAGIC:
            raise ValueError(f"not a shard: {key[0]}")
        payload = np.frombuffer(raw, f"<u{width}", offset=8)
        each = [payload[a : a + n].astype("<u4") for a, n in zip(table["offset"].to_pylist(), table["length"].to_pylist(), strict=True)]
        out = {c: table[c] for c in ("doc_id", "nth", "shard", "offset")} | {"n_tokens": pa.array([len(x) for x in each], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
        return pa.table(out | ({"ids": pa.array([x.tolist() for x in each], pa.list_(pa.int64()))} if ids else {}))

    return located.groupBy("shard").applyInArrow(read, "doc_id long, nth int, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def _running(totals: DataFrame, run: int = 1024) -> DataFrame:
    """(shard, base): the ids of all shards before each, in two steps: runs of ``run`` shards are summed and placed, then the shards within each run."""
    totals = totals.withColumn("run", F.floor(F.col("shard") / run))
    runs = totals.groupBy("run").agg(F.sum("ids").alias("ids"))
    placed = runs.select("run", (F.sum("ids").over(W.orderBy("run")) - F.col("ids")).alias("before"))  # a row for every ``run`` shards
    within = totals.withColumn("upto", F.sum("ids").over(W.partitionBy("run").orderBy("shard")))
    return within.join(placed, "run").select("shard", (F.col("before") + F.col("upto") - F.col("ids")).alias("base"))


def token_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the store and read every document back through the index: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One row a document; rows with one id follow each other. Empty tables give none."""
    uri, directory = write_store(docs, path, end_id=end_id)
    spark = docs.sparkSession
    buckets = max(1, -(-directory.count() // BUCKET_KEYS))
    width = directory.agg(F.max("width")).first()[0] or 4
    totals = directory.groupBy("shard").agg(F.sum("length").alias("ids"))  # a row a shard
    starts = materialize(_running(totals), "starts")
    rows = read_back(uri, width, locate(spark.read.parquet(f"{uri}/directory").select("doc_id", "nth"), uri, buckets))
    return rows.join(starts, "shard").select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
