"""Exact BPE encoding in linear time with longest matches and a table of compatible pairs, and decoding with an offset table.

A sequence of tokens is the merge result of its word exactly if each token is the merge result of its own letters and each
pair of neighbours is that of theirs. The encoder takes the longest vocabulary match at each place (found by an Aho-Corasick
automaton), checks it against the token before, and backs off to the next shorter match, or to the token before, when the pair does not
fit; a place proved dead is never tried again."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomnet.llm.common import NULL_ID, after_letters, as_bytes, bounded_batches, ids_of, kinds_without, pieces, split_words, text_bytes
from loomnet.llm.token_store import Memory, gather

#: Pieces, words and pairs that a Python worker remembers, in each of two generations.
REMEMBER = 100_000
#: A letter that ends a word is written this much higher, so that end marks need no symbol of their own.
FINAL = 256
_CODECS: dict = {}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a tokenizer file: byte-level BPE with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}

        def symbols(token: str) -> str:
            body = token.removesuffix(self.suffix) if self.suffix else token
            text = [to_byte[c] for c in body]
            if self.suffix and body != token:
                text[-1] += FINAL
            return "".join(map(chr, text))

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.space = regex.compile(r"\s+")
        alphabet = "thequickbrownfoxjumpsoverthelazydogsdstllremve"
        self.letters_together = all(self.pattern.findall(w) == [w] for w in (alphabet, *alphabet)) and not any(s.isalpha() for s in self.special)
        names = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.symbols = {symbols(t): i for t, i in names.items()}
        self.rank = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((symbols(a), symbols(b)), k)
        self.fits = Memory(REMEMBER)
        usable = [s for s in self.symbols if len(s) == 1 or self.merged(s) == [s]]
        self.automaton = ahocorasick.Automaton()
        for s in usable:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        # the longest token that begins a token
        usable_set = set(usable)
        self.shorter = {s: next((s[:k] for k in range(len(s) - 1, 0, -1) if s[:k] in usable_set), None) for s in usable}
        self.kind = kinds_without(self.special)
        self.known = Memory(REMEMBER)  # ids of pieces of text
        self.words = Memory(REMEMBER)  # and of what the pattern makes of them
        # decoding: all token texts in a row, each with the space that joins tokens, and where each begins
        by_id = {i: t for t, i in (names | self.special).items()}
        pieces_ = [(by_id.get(i, "") + " ").encode() if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.text = np.frombuffer(b"".join(pieces_), np.uint8)
        self.offset = np.append(0, np.cumsum([len(p) for p in pieces_]))

    def merged(self, word: str) -> list[str]:
        """The merge result of a short word, merge by merge; only for building the tables."""
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def ended(self, raw: str) -> str:
        """A word's bytes as letters, the last one marked."""
        return raw[:-1] + chr(ord(raw[-1]) + FINAL) if self.suffix else raw

    def compatible(self, a: str, b: str) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            ok = self.fits[a, b] = self.merged(a + b) == [a, b]
        return ok

    def encode_word(self, word: str) -> list[str]:
        """The merge result of a word of symbols."""
        if word in self.shorter:
            return [word]
        n = len(word)
        longest = lambda at: next(self.automaton.iter_long(word, at))[1]  # noqa: E731  every letter is a token, so some match begins here
        out, at, token, dead = [], 0, longest(0), bytearray(n + 1)
        while True:
            while token is not None and (dead[at + len(token)] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                if at == n:
                    return out
                token = longest(at)
            else:  # nothing fits here: the token before must be shorter
                dead[at] = 1
                if not out:
                    raise ValueError(f"no encoding for {word!r}")
                last = out.pop()
                at -= len(last)
                token = self.shorter[last]

    def encode_text(self, text: str) -> list[int]:
        """The ids of a text, or of a piece of one that white space bounds."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = part.isascii()
                part = self.space.sub(" ", part if plain else unicodedata.normalize("NFC", part))
                part = part.lower() if plain else "".join(c.lower() for c in part)
                for word in self.pattern.findall(part):
                    ids = self.words.get(word)
                    if ids is None:
                        raw = self.ended(word.encode().decode("latin-1"))
                        ids = self.words[word] = array("I", [self.symbols[s] for s in self.encode_word(raw)])
                    out += ids
        return out

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of a piece, four bytes each. A piece of ASCII letters only is one word to the pattern, if it takes letters together."""
        if self.letters_together and piece.isalpha():
            return array("I", [self.symbols[s] for s in self.encode_word(self.ended(piece.lower().decode("latin-1")))]).tobytes()
        return array("I", self.encode_text(piece.decode())).tobytes()

    def encode(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (bytes and offsets as text_bytes() has them), and how many each has. Each different word is encoded once."""
        words, of = split_words(data, first, also=after_letters(data, self.kind))  # the pattern always ends a match there
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(first) - 1, np.int64)
        coded = words.dictionary_encode()
        different = as_bytes(coded.dictionary)
        each = list(map(self.known.get, different))
        new = [k for k, ids in enumerate(each) if ids is None]
        for k in new:
            each[k] = self.known[different[k]] = self.encode_piece(different[k])
        ids, counts = gather(each, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(np.append(0, np.cumsum(counts))[of])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of id sequences that stand in a row: token texts joined by one space, as UTF-8."""
        ids = ids.astype(np.int64)
        sizes = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(sizes)
        flat = self.text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[ids] - (ends - sizes), sizes)].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return [flat[a : max(a, b - 1)] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def codec(path: str) -> Bpe:
    if path not in _CODECS:
        _CODECS[path] = Bpe(path)
    return _CODECS[path]


def bpe(docs: DataFrame, path: str, tokens: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Null and empty texts have no tokens and decode to an empty text. Each row is treated by itself, so repeated rows give equal
    rows, a null doc_id is kept and an empty table gives none. Texts may be of any length; they are handled a few MB at a time."""

    def run(batches):
        own = codec(path)
        for batch in pieces(batches, "text", 3_000_000):
            keys = ids_of(batch.column("doc_id"))
            ids, counts = own.encode(*text_bytes(batch.column("text")))
            decoded = own.decode(ids, counts)
            ends = np.append(0, np.cumsum(counts))
            each = [ids[a:b].astype("<u4") for a, b in zip(ends, ends[1:], strict=False)]
            out = [pa.array(keys, mask=keys == NULL_ID), pa.array(counts), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                out += [pa.array([x.tolist() for x in each], pa.list_(pa.int64())), pa.array([x.decode() for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * tokens)
