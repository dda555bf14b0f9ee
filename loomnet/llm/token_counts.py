"""Token counts without ids: every distinct pre-token is counted once, for the whole corpus, and documents are sums over their pre-token frequencies.

A pre-token is what the vocabulary file's own pre-tokenizer cuts (or a special token's string, which counts as one), and the merges of a byte-level vocabulary never
cross pre-tokens. So the corpus is read once, into blocks: the different pre-tokens of some 32 MB of text and, for each document, which of them it has how often. The blocks'
pre-tokens meet in one table that holds each of them once; that table alone is tokenised, joined back to the blocks that asked, and summed."""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, as_bytes, bounded_batches, ids_of, kinds_without, materialize, pieces, text_bytes
from loomnet.llm.token_store import Memory, _chunks, gather

#: Chunks of text whose pre-tokens a Python worker remembers, in each of two generations.
REMEMBER = 100_000
#: Bytes of text that are cut at once, and of a block (a longer text makes a block of its own).
PART_BYTES, BLOCK_BYTES = 3_000_000, 32_000_000
#: Bits for the number of a pre-token within a block, and of a block within a task.
AT_BITS, BLOCK_BITS = 28, 12
#: Before the string of a special token; no pre-token holds it, as byte-level letters are printable.
SPECIAL = "\0"
_SPLITTERS: dict = {}


class Splitter:
    """Cuts text into pre-tokens as a byte-level tokenizer file says, and counts the tokens of one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path} is no byte-level vocabulary that takes texts as they are")
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"special tokens of {path} that depend on what stands beside them are not supported")
        self.model, self.cut = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content for t in added}
        self.part = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.kind = kinds_without(self.special)
        self.known = Memory(REMEMBER)

    def split(self, chunk: bytes) -> list[str]:
        """The pre-tokens of a chunk, in byte-level letters."""
        text = chunk.decode()
        if self.part is None or not self.part.search(text):
            return [p for p, _ in self.cut(text)]
        return list(chain.from_iterable([SPECIAL + part] if part in self.special else [p for p, _ in self.cut(part)] for part in self.part.split(text) if part))

    def count(self, piece: str) -> int:
        return 1 if piece.startswith(SPECIAL) else len(self.model.tokenize(piece))

    def frequencies(self, data: np.ndarray, first: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts in a row: how many different pre-tokens each has; which, in ascending order text by text; and how often. ``number`` numbers pre-tokens and grows."""
        chunks, of = _chunks(data, first, self.kind)
        if not len(chunks):
            return np.zeros(len(first) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = chunks.dictionary_encode()
        each = []
        for chunk in as_bytes(coded.dictionary):
            cut = self.known.get(chunk)
            if cut is None:
                cut = self.known[chunk] = self.split(chunk)
            each.append(array("I", [number.setdefault(p, len(number)) for p in cut]).tobytes())
        flat, counts = gather(each, coded.indices.to_numpy(zero_copy_only=False))
        within = np.diff(np.append(0, np.cumsum(counts))[of])  # pre-tokens of each text
        pair, times = np.unique(np.repeat(np.arange(len(within)), within) * len(number) + flat, return_counts=True)
        return np.bincount(pair // len(number), minlength=len(within)), pair % len(number), times


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, compressed."""
    return zlib.compress(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes(), 4)


def _large(raw: bytes, n: int) -> np.ndarray:
    """What _small() wrote, ``n`` numbers."""
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "u1").astype(np.int64)


def _begins(different: np.ndarray) -> np.ndarray:
    """Where each text that has pre-tokens begins among all texts' pre-tokens."""
    return (np.cumsum(different) - different)[different > 0]


def _numbers(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The numbers whose steps, text by text, these are."""
    total = np.cumsum(steps)
    before = total[begins] - steps[begins]
    return total - np.repeat(before, np.diff(np.append(begins, len(steps))))


class Block:
    """What is counted of some texts: their keys, their sizes and their frequencies over the block's own pre-tokens."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, own: Splitter, keys: np.ndarray, data: np.ndarray, first: np.ndarray) -> None:
        different, which, times = own.frequencies(data, first, self.number)
        begins = _begins(different)
        steps = np.diff(which, prepend=0)  # ascending within a text, so what follows a text's first number are small steps
        steps[begins] = which[begins]
        self.parts.append((keys, np.diff(first), different, steps, times - 1))
        self.bytes += len(data)

    def row(self, block: int) -> pa.RecordBatch:
        if len(self.number) >> AT_BITS or block >> (63 - AT_BITS):
            raise OverflowError("too many pre-tokens in a block, or too many blocks")
        keys, size, different, steps, more = (np.concatenate([p[k] for p in self.parts]) for k in range(5))
        values = [pa.array([v], pa.binary()) for v in (zlib.compress(keys.astype(np.int64).tobytes(), 1), _small(size), _small(different), _small(steps), _small(more))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([len(steps)], pa.int64()), pa.array([list(self.number)], pa.list_(pa.string())), *values], names=FIELDS)


FIELDS = ["block", "texts", "entries", "pieces", "doc_ids", "n_bytes", "different", "steps", "more"]


def frequency_blocks(docs: DataFrame, path: str) -> DataFrame:
    """A table, written to the shared folder, with a row a block: block, its different pre-tokens (pieces), and the documents' frequencies over them."""

    def run(batches):
        own, task, at, block = splitter(path), TaskContext.get().partitionId(), 0, Block()
        for batch in pieces(batches, "text", PART_BYTES):
            data, first = text_bytes(batch.column("text"))
            if block.parts and block.bytes + len(data) > BLOCK_BYTES:
                yield block.row((task << BLOCK_BITS) + at)
                at, block = at + 1, Block()
            block.add(own, ids_of(batch.column("doc_id")), data, first)
        if block.parts:
            yield block.row((task << BLOCK_BITS) + at)

    bounded_batches(docs.sparkSession)
    schema = "block long, texts int, entries long, pieces array<string>, doc_ids binary, n_bytes binary, different binary, steps binary, more binary"
    return materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema), "frequencies", "zstd")


def piece_counts(asked: DataFrame, path: str) -> DataFrame:
    """(block, answer) for (key, piece): each different pre-token meets all that ask for it in one place and is tokenised once there.

    An answer is the pre-token's number within the block, times 2^32, and its tokens: one whole number takes a third of the bytes of two in a row."""

    def run(batches):
        own, last, n = splitter(path), None, 0
        for batch in batches:
            out = []
            for piece in batch.column("piece").to_pylist():
                if piece != last:
                    last, n = piece, own.count(piece)
                out.append(n)
            key = batch.column("key").to_numpy()
            order = np.argsort(key)
            key = key[order]
            yield pa.RecordBatch.from_arrays([pa.array(key >> AT_BITS), pa.array(((key & ((1 << AT_BITS) - 1)) << 32) + np.array(out, np.int64)[order])], names=["block", "answer"])

    return asked.repartition("piece").sortWithinPartitions("piece").select("key", "piece").mapInArrow(run, "block long, answer long")


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of every text under the byte-level vocabulary file at ``path``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Special tokens' strings inside texts count as one token, none is added. Null and empty texts have no bytes and no tokens. Every row is counted by itself, so
    repeated rows give equal rows and a null doc_id is kept; an empty table gives none. Texts may be of any length: one task holds one block or one text. A pre-token
    that all documents share makes one row a block, never one a document."""
    blocks = frequency_blocks(docs, path)
    asked = blocks.select("block", F.posexplode("pieces").alias("at", "piece")).select((F.shiftleft("block", AT_BITS) + F.col("at")).alias("key"), "piece")
    answers = piece_counts(asked, path).groupBy("block").agg(F.sort_array(F.collect_list("answer")).alias("answers"))  # as many as a block has pre-tokens

    def total(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.frombuffer(zlib.decompress(row["doc_ids"]), np.int64), row["entries"]
                size, different = (_large(row[c], row["texts"]) for c in ("n_bytes", "different"))
                each = (np.array(row["answers"] or [], np.int64) & 0xFFFFFFFF)[_numbers(_large(row["steps"], n), _begins(different))] * (_large(row["more"], n) + 1)
                sums = np.diff(np.append(0, np.cumsum(each))[np.append(0, np.cumsum(different))])
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NULL_ID), pa.array(size), pa.array(sums), pa.array(sums > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = blocks.drop("pieces").join(answers.hint("shuffle_hash"), "block", "left")
    return rows.mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
