"""Hard negatives, token counts and spelling variants against plain Python and the tokenizers library."""

import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from loomnet.llm import hard_negatives, queries, spelling_variants, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- hard negatives ------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives=5, lower=80, upper=100, scale=256):
    """Row by row: rows are (id, label, vector), fit to take part."""
    whole = {i: (label, [int(np.floor(scale * x)) for x in v]) for i, label, v in rows}
    out = []
    for a in anchors:
        label, v = whole[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            near = [(-n, i) for n, i, other in scores if other != label and lower * -s <= 100 * -n <= upper * -s][:negatives]
            out += [(a, p, k, i, -s, n) for k, (n, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(spark, rows, parts=4):
    """A table of vectors with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, label, v, 1, "b", 0) for i, label, v in rows], "vec_id long, label int, embedding array<double>, b int, s string, nth int").repartition(parts)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
EVERY = lambda: F.col("vec_id") % 10 == 0


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # few different values, so that scores tie often, and blocks and sets of anchors of a few rows
    rows = [(k, int(rng.integers(0, 4)), rng.integers(0, 4, 6).astype(float).tolist()) for k in range(200)]
    rows += [(200 + k, 1, [1.0, 2.0, 0.5, 0.25, 0.0, -0.1]) for k in range(100)]
    odd = [(400, None, [1.0] * 6), (410, 1, None), (420, 1, [float("nan")] + [1.0] * 5), (430, 1, [None] + [1.0] * 5), (440, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (450, 1, [1.0]), rows[10], rows[20], (20, 3, [9.0] * 6)]
    first = sorted([rows[20], (20, 3, [9.0] * 6)], key=lambda r: (r[2], r[1]))[0]
    kept = [r for r in rows if r[0] != 20] + [first]
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "LEAST", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "SCORES", 100)
    out = hard_negatives.hard_negatives(vectors(spark, rows + odd), EVERY())
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == mined(kept, range(0, 300, 10))
    out = hard_negatives.hard_negatives(vectors(spark, rows), EVERY(), F.col("label") % 2, positives=3, negatives=2, lower=50, upper=90, scale=3)
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == mined([(i, x % 2, v) for i, x, v in rows], range(0, 300, 10), 3, 2, 50, 90, 3)


def test_hard_negatives_at_the_edges(spark):
    rows = [(k, k % 2, [float(k), -1.0]) for k in range(6)]
    run = lambda r, **more: hard_negatives.hard_negatives(vectors(spark, r), EVERY(), **more)
    assert run([]).columns == list(COLUMNS) and run([]).count() == 0
    assert run([(0, 1, [1.0])]).count() == 0 and run([(0, 1, [1.0]), (1, 2, [1.0])]).count() == 0
    assert run([(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-1.0, 0.0])]).count() == 0  # a negative limit
    # scores beyond the whole numbers of a double, in 64 bits
    large = [(i, x, [v[0] * 2.0**20 + 1, 2.0**21]) for i, x, v in rows]
    assert sorted(tuple(r) for r in run(large, lower=0).select(*COLUMNS).collect()) == mined(large, [0], lower=0)
    with pytest.raises(Exception, match="64-bit whole numbers"):
        run([(i, x, [1e300, 1.0]) for i, x, v in rows]).collect()


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op11_hard_negatives(spark, SF)
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == mined(rows, [i for i, _, _ in rows if i % 100 == 0])


# --- token counts ------------------------------------------------------------------------


def counted(docs):
    own = tokenizers.Tokenizer.from_file(PATH)
    out = [(i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in docs]
    return sorted(map(repr, [(*r, r[2] > 512) for r in out]))


def texts(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "x", 0, 1) for i, t in docs], "doc_id long, text string, piece string, block int, n int").repartition(parts)


def test_token_counts(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'LL", ".", "!?", "1", "²", "<|endoftext|>", "<|", "|>", "日", "😀", " ", " ", "́", "\x00", "\r\n", "don't", " the"]
    docs = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(None, None), (None, "no id"), (7, None), (7, ""), (7, "again"), (7, "again"), (500, "word " * 600), (501, "x" * 200_000), (502, " ".join(f"w{k}" for k in range(20_000)))]
    for part, block in ((token_counts.PART_BYTES, token_counts.BLOCK_BYTES), (200, 1000)):
        monkeypatch.setattr(token_counts, "PART_BYTES", part)
        monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
        out = token_counts.token_counts(texts(spark, docs), PATH)
        assert sorted(map(repr, (tuple(r) for r in out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))) == counted(docs)
    assert token_counts.token_counts(texts(spark, []), PATH).count() == 0


def test_every_piece_is_counted_once(spark, monkeypatch, tmp_path):
    """However many documents and blocks have a pre-token, it is tokenised once."""
    count = token_counts.Splitter.count

    def noted(self, piece):
        with open(tmp_path / "counted", "a") as f:
            f.write(piece + "\n")
        return count(self, piece)

    monkeypatch.setattr(token_counts.Splitter, "count", noted)
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 100)
    out = token_counts.token_counts(texts(spark, [(k, "the same few words, the same") for k in range(100)]), PATH)
    if out.where("n_tokens = 7").count() == 100 and (tmp_path / "counted").exists():  # where tasks share the driver's patch
        assert sorted((tmp_path / "counted").read_text().split()) == sorted(("the", "Ġsame", "Ġfew", "Ġwords", ",", "Ġthe"))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Splitter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op12_token_counts(spark, SF)
    assert sorted(map(repr, (tuple(r) for r in out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))) == counted(docs)


# --- spelling variants ---------------------------------------------------------------------


def variants(docs, least=7, occurrences=2, times=10, damage=0):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= occurrences}
    letters = sorted({c for w in count for c in w})
    near = {}
    for w in count:
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near[w] = (edits - {w}) & set(count)
    form = {w: max(near[w], key=lambda o: (count[o], [-ord(c) for c in o])) for w in count if near[w]}
    form = {w: f for w, f in form.items() if count[f] >= times * count[w]}
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(map(repr, out))


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())))


def paragraphs():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    docs = []
    for k in range(120):
        words = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdeéÿ") + w[at:], w[:at] + rng.choice("abcdeéÿ") + w[at + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper() if w.isascii() else w]))
        docs.append((k, rng.choice([" ", ", ", "1", "\n", "ā", "-"]).join(words)))
    return docs + [(None, "wordless wordless"), (None, None), (5, ""), (5, "z" * 200 + " " + "z" * 200 + " " + "z" * 199 + " " + "z" * 199), docs[0], docs[0]]


def test_spelling_variants(spark):
    docs = paragraphs()
    table = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in docs], "doc_id long, text string, n int, word string, k int").repartition(3)
    for large, damage in ((spelling_variants.LARGE, 31), (1, 0), (8, 5)):
        assert found(spelling_variants.spelling_variants(table, damage=damage, large=large)) == variants(docs, damage=damage)
    assert found(spelling_variants.spelling_variants(table, least=3, occurrences=1, times=2)) == variants(docs, 3, 1, 2)
    assert spelling_variants.spelling_variants(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(table, times=1)


def test_chains_of_forms(spark):
    words = [f"abcdefg{'h' * k}" for k in range(6)]
    docs = [(k, " ".join([w] * (2 * 3 ** (5 - k)))) for k, w in enumerate(words)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.word: r for r in spelling_variants.spelling_variants(table, times=3).collect()}
    assert [out[w].form for w in words] == [None, *words[:-1]] and {r.root for r in out.values()} == {words[0]}


def test_checksums_of_joined_parts():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 64, 65, 500) for _ in range(4)]
    prefixes = [b":", b"12:", b"-9223372036854775808:"]
    a, b = np.repeat(np.arange(3), len(words)), np.tile(np.arange(len(words)), 3)
    assert spelling_variants.checksums(prefixes, words, a, b).tolist() == [zlib.crc32(prefixes[p] + words[w]) for p, w in zip(a, b, strict=True)]


def test_one_edit_flips_two_bits_at_most():
    rng = random.Random(4)
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    for _ in range(300):
        w = "".join(rng.choice(letters) for _ in range(8))
        at = rng.randrange(8)
        for other in (w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]):
            bands = spelling_variants.masks([w, other])[1]
            assert np.bitwise_count(bands[:, 0] ^ bands[:, 1]).sum() <= 2 and (bands[:, 0] == bands[:, 1]).any()
            assert spelling_variants.one_edit(w, other) == (w != other)
    assert not spelling_variants.one_edit("abc", "acb") and not spelling_variants.one_edit("abc", "abcde")


def test_crowded_buckets_send_rows_in_proportion_to_words(spark):
    """All words of one letter pattern fall into one bucket of every band; what is written for them grows with the words."""
    words = [("ab" * 4)[: k % 3] + f"{k:011b}".replace("0", "xx").replace("1", "yy") for k in range(2000)]
    table = spark.createDataFrame([(w, 2) for w in sorted(set(words))], "word string, n long")
    few = spelling_variants.near_words(table, large=100).select("word", "near")
    every = spelling_variants.near_words(table, large=10**6).select("word", "near")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))
