"""Operators against brute force, round trips and held-out accuracy; nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import datetime
import hashlib
import os
import random
import re
import sys
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from loomnet.llm import additive_search, bpe, common, decontamination, induced_sort, jaccard_join, line_dedup, queries, substring_dedup, suffix_dedup, token_store, toxicity, url_filters  # noqa: E402

SF = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))
    passage, tail = prose(90), prose(40)
    base = prose(220)
    edited = base.split(" ")
    edited[100] = "changed"
    twice = base.split(" ")
    twice[20] = twice[150] = "CHANGED"
    docs = [
        (3, base), (1, prose(50) + " " + passage + " " + prose(30)), (2, passage), (7, None), (8, ""), (9, " \t\n "), (10, base), (11, " ".join(edited)), (12, " ".join(twice)),
        (13, prose(10) + " " + passage + " " + tail), (14, tail + "\n\n" + passage[5:]), (15, "one two"), (16, "one two"), (17, "ab " * 400), (18, "x" * 3000), (19, "ü😀 " * 200),
        (20, "l1\nl2\nl3\nl1\nl2\nl3\nl1"), (21, "l0\nl1\nl2\nl3\nl9"), (None, base), (None, None), (22, prose(4000)),
    ]
    return docs + [(30 + k, " ".join(w if rng.random() > 0.01 else rng.choice(vocabulary) for w in base.split(" "))) for k in range(12)]


def frame(spark, docs, parts=3):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), None, 1, "x") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pid string, h int, node string").repartition(parts)


def got(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def want(rows):
    return sorted(map(repr, rows))


DOCS = corpus()
REPEATED = [*DOCS, DOCS[0], DOCS[1], DOCS[3], DOCS[4]]


@pytest.mark.parametrize("docs", [DOCS, REPEATED, []])
def test_substring_dedup(spark, docs):
    out = substring_dedup.substring_dedup(frame(spark, docs), window=13, texts=True).cache()
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring_dedup(docs))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out.collect())


def test_substring_ladder(spark):
    assert substring_dedup.ladder(50, 7) == [7, 13, 25, 50]
    out = substring_dedup.substring_dedup(frame(spark, DOCS), window=50)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring_dedup(DOCS, 50))


@pytest.mark.parametrize("docs, length, most", [(DOCS, 60, 128), (DOCS, 60, 1), (DOCS, 60, 3), (REPEATED, 400, 128), ([], 400, 128)])
def test_suffix_dedup(spark, docs, length, most):
    out = suffix_dedup.suffix_dedup(frame(spark, docs), length=length, most=most)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.suffix_dedup(docs, length))


def test_suffix_arrays_decide():
    """Digests that agree by mistake mark nothing, copies and shared windows are marked by common prefixes."""
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    a, b, core = text(703), text(703), text(420)
    c, d = text(5) + core + text(9), text(50) + core + text(1)
    unit = lambda kind, shard, digest, h, lead, payload: (0, kind, shard, 0, digest, digest, h, h, h, 0, lead, 0, 385, True, payload)
    twin, mixed = suffix_dedup.TWIN, suffix_dedup.MIXED
    rows = [unit(twin, 1, 1, 1, 300, a), unit(twin, 1, 1, 1, 300, b), unit(twin, 2, 2, 2, 300, a), unit(twin, 2, 2, 2, 300, a), unit(mixed, 3, 3, 3, 5 + 200, c), unit(mixed, 3, 4, 4, 50 + 200, d), unit(mixed, 4, 5, 5, 300, a), unit(mixed, 4, 6, 6, 300, b)]
    found = [(r[0], r[5], r[8], r[9], np.frombuffer(r[10], np.int32).tolist() if r[10] else None) for r in suffix_dedup._sorted(suffix_dedup._rows(suffix_dedup.UNIT, rows), 400)]
    assert sorted(found, key=str) == [(twin, 2, 0, 304, None), (mixed, 3, 0, 0, list(range(5, 26))), (mixed, 4, 0, 0, list(range(50, 71)))]


def test_crowded_shards():
    """Three hundred units at the rim of one passage, against counts of all their windows."""
    rng = random.Random(5)
    text = lambda n: bytes(rng.choice(b"abcdefghij klmn") for _ in range(n))
    core, seen = text(784), {}
    cuts = [rng.randrange(0, 200) for _ in range(300)]
    payloads = [text(384 - x) + core[384 - x :] for x in cuts]
    rows = [(0, suffix_dedup.MIXED, 3, 0, k, k, 3, k, k, 0, 384, 0, 385, True, t) for k, t in enumerate(payloads)]
    for t in payloads:
        for p in range(385):
            seen[t[p : p + 400]] = seen.get(t[p : p + 400], 0) + 1
    found = {r[6]: np.frombuffer(r[10], np.int32).tolist() for r in suffix_dedup._sorted(suffix_dedup._rows(suffix_dedup.UNIT, rows), 400)}
    assert found == {k: [p for p in range(385) if seen[t[p : p + 400]] > 1] for k, t in enumerate(payloads)}


def test_suffix_query_by_brute_force(spark):
    """The registered query over all documents of sf0.01, by digests of every window."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op9_suffix_array_dedup(spark, "/root/testdata/sf0.01")
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.suffix_dedup(docs, 400))


def test_induced_sorting():
    rng = np.random.default_rng(0)
    for trial in range(40):
        shards = sorted(([int(x) + 1 for x in rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 50))] for _ in range(rng.integers(1, 7))), key=len, reverse=True)
        if trial % 3 == 0:
            shards = [(s[:5] * 12)[: len(s)] for s in shards]
        starts = np.append(0, np.cumsum([len(s) + 1 for s in shards]))
        text = np.concatenate([s + [0] for s in shards])
        array = induced_sort.suffix_arrays(text, starts)
        shared = induced_sort.common_prefixes(text, starts, array, 3, 10)
        for a, s in zip(starts, shards, strict=False):
            s = s + [0]
            order = sorted(range(len(s)), key=lambda i: s[i:])
            assert [a + i for i in order] == array[a : a + len(s)].tolist()
            lcp = lambda i, j: next(k for k in range(len(s) + 1) if max(i, j) + k >= len(s) or s[i + k] != s[j + k])  # noqa: B023, E731
            for k, i in enumerate(order):
                assert min(10, max([lcp(i, order[j]) for j in (k - 1, k + 1) if 0 <= j < len(order)] or [0])) == shared[a + i]


def test_line_dedup(spark):
    unique = DOCS[:18] + DOCS[20:]
    out = line_dedup.line_dedup(frame(spark, unique))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pid", "h", "node", "n_lines", "n_removed"]
    assert got(out, "doc_id", "n_lines", "n_removed", "text") == want(brute.line_dedup(unique))
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    twice = line_dedup.line_dedup(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]))
    assert got(twice, "doc_id", "n_removed") == want([(1, 0), (1, 0), (2, 3)])


@pytest.mark.parametrize("docs", [REPEATED, []])
def test_jaccard_join(spark, docs):
    out = jaccard_join.jaccard_join(frame(spark, docs), leaf=4)
    assert got(out, "doc_id", "class_id", "n_copies", "n_links", "group_id") == want(brute.jaccard(docs))


def test_jaccard_blocks(spark, monkeypatch):
    """A group too large for one block, cut into pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    docs = [d for d in DOCS if d[0] is not None]
    out = jaccard_join.jaccard_join(frame(spark, docs), leaf=2)
    assert got(out, "doc_id", "n_links", "group_id") == want([(i, n, g) for i, _, _, n, g in brute.jaccard(docs)])
    kept = {r.doc_id for r in jaccard_join.keep_one(frame(spark, docs)).collect()}
    assert kept == {i for i, _, _, _, g in brute.jaccard(docs) if i == g}


def test_near_copies_of_many_kinds(spark, monkeypatch):
    """A large part with sets near to its first one, far from it, and linked only to each other."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(17)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [f"n{k}", "x"], [f"s{at}"]])
        texts.append(" ".join(words))
    docs = list(enumerate(texts, 5))
    out = jaccard_join.jaccard_join(frame(spark, docs), leaf=4)
    assert got(out, "doc_id", "class_id", "n_copies", "n_links", "group_id") == want(brute.jaccard(docs))


def test_run_count():
    """The recall that the runs are chosen for, against pairs that walk through random buckets."""
    assert jaccard_join.branches(0.8) == (1, pytest.approx(0.25))
    rng, alive = random.Random(2), 0
    for _ in range(20_000):
        paths = 1
        for _ in range(jaccard_join.LEVELS):
            paths = sum(rng.random() < 0.8 for _ in range(sum(1 + (rng.random() < 0.25) for _ in range(paths))))
        alive += paths > 0
    assert abs(alive / 20_000 - jaccard_join.survival(0.8)) < 0.02
    assert 1 - (1 - jaccard_join.survival(0.8)) ** jaccard_join.run_count(0.8, 0.999) >= 0.999


def test_decontamination(spark):
    items = [(1, DOCS[2][1][:200]), (2, "one two"), (3, None), (4, "..."), (None, "AB ab Ab aB ab AB ab ab ab ab ab ab"), (5, DOCS[2][1][:200].upper()), (1, DOCS[2][1][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = want(brute.decontaminate(REPEATED, items))
    assert got(decontamination.decontaminate(frame(spark, REPEATED), bench), *columns) == expected
    assert got(decontamination.decontaminate(frame(spark, REPEATED), bench, broadcast_rows=0), *columns) == expected
    empty = decontamination.decontaminate(frame(spark, DOCS), bench.where("false"))
    assert empty.where("contaminated or n_items > 0").count() == 0 and empty.count() == len(DOCS)
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0
    kept = decontamination.drop_contaminated(frame(spark, DOCS), bench)
    assert got(kept, "doc_id") == want([(r[0],) for r in brute.decontaminate(DOCS, items) if not r[5]]) and kept.columns == frame(spark, []).columns


def test_url_filters(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    log = [("a", "bad.example", "add", day(2)), ("a", "bad.example", "remove", day(5)), ("a", "Bad.Example", "add", day(8)), ("b", "x.example/p/q/", "add", day(1)), ("b", None, "add", day(1)), ("c", "bad.example", "add", day(5)), ("c", "bad.example", "remove", day(5)), ("d", "y.example", "add", None)]
    captures = [
        (1, "http://bad.example/", day(1)), (2, "https://WWW.Bad.Example:80/z?q#f", day(2)), (3, "http://bad.example", day(5)), (4, "http://u@sub.bad.example./", day(9)), (5, "http://notbad.example/", day(9)),
        (6, "http://x.example/p/q/r", day(3)), (7, "http://x.example/p/qq", day(3)), (8, None, day(3)), (9, "nonsense", day(3)), (10, "http://bad.example/", None), (4, "http://u@sub.bad.example./", day(9)), (11, "http://y.example/", day(9)),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz").withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(log, "list_name string, pattern string, action string, listed_at timestamp_ntz")
    for limit in (10, 0):
        out = url_filters.url_filter(c, e, broadcast_rows=limit)
        assert sorted(r.page_id for r in out.where("blocked").collect()) == [2, 4, 4, 6]
        assert out.count() == len(captures)
    assert url_filters.url_filter(c, e.where("false")).where("blocked").count() == 0
    assert url_filters.url_filter(c.where("false"), e).count() == 0


def test_long_urls(spark):
    """A path of 50,000 steps and a host of 2,000 labels take no longer than others."""
    log = spark.createDataFrame([("a", "x.example/p/q", "add", datetime.datetime(2024, 1, 1))], "list_name string, pattern string, action string, listed_at timestamp_ntz")
    urls = ["http://x.example/p/q" + "/s" * 50_000, "http://x.example" + "/s" * 50_000, "http://" + "a." * 2000 + "x.example/p/q/", "http://x.example/p//q"]
    c = spark.createDataFrame([(k, u, datetime.datetime(2024, 2, 1)) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp_ntz")
    start = time.time()
    assert sorted(r.page_id for r in url_filters.url_filter(c, log).where("blocked").collect()) == [0, 2, 3]
    assert time.time() - start < 60


def test_running_totals(spark):
    totals = spark.createDataFrame([(k, k + 1) for k in range(3000)], "shard int, ids long")
    assert {(r.shard, r.base) for r in token_store._running(totals, 64).collect()} == {(k, k * (k + 1) // 2) for k in range(3000)}


def fuzz():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßİıΣσςΑΩ你好한😀🇩🪿́̈  　\u0085\x1c\x1f\x0b '’s\t\n\r .,!?0123½Ⅻ‍​-_=#<|>ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["a<|endoftext|>b <|startoftext|> c<|endoftext|>", "  lead  two   spaces ", "it's we'll I'D", "Hello  World\n\n\nfoo \n bar ", " ", "\n", "a" * 300, "", "thing " * 3000]


def test_bpe_is_exact():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, theirs, texts = bpe.codec(path), tokenizers.Tokenizer.from_file(path), fuzz()
    theirs.no_truncation()
    theirs.no_padding()
    ids, counts = own.encode(*common.text_bytes(pa.array(texts)))
    decoded, ends = own.decode(ids, counts), np.append(0, np.cumsum(counts))
    for k, text in enumerate(texts):
        right = theirs.encode(text, add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == right, text
        assert decoded[k].decode() == theirs.decode(right, skip_special_tokens=False)


def test_bpe_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.bpe(frame(spark, REPEATED), path, tokens=True).collect()}
    theirs = tokenizers.Tokenizer.from_file(path)
    ids = [(i, theirs.encode(t or "", add_special_tokens=False).ids) for i, t in REPEATED]
    assert out == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids}
    assert bpe.bpe(frame(spark, []), path).count() == 0


def test_chunked_encoding_is_exact():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs, texts = token_store.ChunkEncoder(path), tokenizers.Tokenizer.from_file(path), fuzz()
    ids, counts = own(*common.text_bytes(pa.array(texts)))
    ends = np.append(0, np.cumsum(counts))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash():
    keys = common.mix(np.arange(50_000, dtype=np.uint64))
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(50_000))
    ids, zeros = np.arange(0, 300_000, 3), np.zeros(100_000, np.int64)
    index = token_store.build_index(ids, zeros, zeros, ids * 5, zeros + 7)
    hit = token_store.look_up(index, ids, zeros)
    assert hit["found"].all() and (hit["offset"] == ids * 5).all() and (hit["length"] == 7).all()
    assert token_store.look_up(index, ids + 1, zeros)["found"].mean() < 1e-4


def test_token_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, at, expected = tokenizers.Tokenizer.from_file(path), 0, []
    docs = [d for d in DOCS if d[0] is not None]
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(token_store.token_ids(frame(spark, docs), path), "doc_id", "start", "n_tokens", "ids_crc32") == want(expected)
    assert token_store.token_ids(frame(spark, []), path).count() == 0
    both = token_store.token_ids(frame(spark, REPEATED), path).collect()
    assert len(both) == len(REPEATED) and sum(r.n_tokens for r in both) == max(r.start + r.n_tokens for r in both)


def test_additive_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[5] = x[900] = x[901]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] + [1.0] * 15), (4060, [None] + [1.0] * 15), (None, [1.0] * 16), (4080, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, norm int").repartition(4)
    out = additive_search.additive_search(df, F.col("vec_id") % 20 == 0, k=20, books=8, shortlist=200).collect()
    assert {r.query_id for r in out} == set(range(0, 3000, 20))
    found = 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        scores = x @ x[q]
        scores[q] = -np.inf
        found += len(set(np.lexsort((np.arange(3000), -scores))[:20]) & {r.vec_id for r in own})
        assert all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-9 for r in own)
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
    assert found / (150 * 20) >= 0.9
    assert additive_search.additive_search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert len(additive_search.additive_search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()) == 2


def test_samples_of_any_size(spark):
    """The share that is sampled never rounds to nothing, and shortlists follow the index."""
    ids = spark.range(100_000).select(F.col("id").alias("vec_id"))
    assert 1500 < ids.where(additive_search.sampled(100_000, 1000)).count() < 2500
    for total in (10**9, 4 * 10**11, 10**14):
        text = ids.where(additive_search.sampled(total, 8192))._jdf.queryExecution().optimizedPlan().toString()
        bound = int(text.split("< ")[1].split(")")[0])
        assert bound + 2**63 == pytest.approx(2**65 * 8192 / total, rel=1e-3) and "Filter" in text
    assert [additive_search.shortlist_for(n) for n in (1, 20_000, 80_000, 2_000_000)] == [512, 512, 1024, 5120]


def test_block_shares():
    """Of a shortlist dealt over blocks by chance none is cut off."""
    rng = np.random.default_rng(4)
    for blocks in (1, 7, 100, 1000):
        counts = rng.multinomial(512, [1 / blocks] * blocks, 300)
        assert counts.max() <= additive_search.block_share(512, blocks)


def test_search_query(spark):
    """The registered query: recall against exact search, with equal vectors in the order of their ids."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    out = queries.op4_additive_search(spark, SF).collect()
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == ids[q])
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1))
        found += len({v for _, v, _ in own} & {int(ids[i]) for i in order}) / len(order)
    assert found / (ids % 20 == 0).sum() >= 0.95


def test_patterns():
    own = toxicity.Grammar()
    names = lambda text: {toxicity.PATTERNS[k] for k in np.flatnonzero(own.features(pa.array([text]))[0])}
    assert names("you are an idiot") == {"insult_at_target"}
    assert names("what an idiot you are") == {"insult_at_target"}
    assert names("idiot. you") == {"insult"}
    assert names("not an idiot") == {"insult_negated"}
    assert names("she said that idiot") == {"insult_at_target_reported"}
    assert names("i will kill you") == {"threat_at_target"}
    assert names("they kill it") == {"violence_at_target"} and names("kill") == {"violence"}
    assert names("going to hurt someone") == {"threat"} and names("what a complete idiot") == {"strong_insult"}
    assert names("you waste of space") == {"strong_insult_at_target"} and names("space of waste") == set()
    assert names("you idiot, idiot a b c you") == {"insult_at_target"} and names("idiot a b c d you") == {"insult"}
    assert names("nothing here") == set()
    scores = own.scores(own.features(pa.array(["you idiot", "not an idiot", "fine", "", None])))
    assert scores[0] > 0.5 > scores[1] > scores[2] == scores[3] == scores[4]


def test_machine_by_brute_force():
    """The composed machine against a reader that looks around every word of a clause."""
    rng, own = random.Random(8), toxicity.Grammar()
    words = [*"idiot kill you not said will such waste piece of space x y z".split(), "x", "y", "z", "w"]
    for _ in range(3000):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 16))]
        found = own.features(pa.array([" ".join(clause)]))[0]
        want_ = brute.clause_patterns(clause, own.symbol, toxicity)
        assert np.rint(np.expm1(found)).astype(int).tolist() == [want_.count(p) for p in toxicity.PATTERNS], clause


def test_toxicity_query(spark):
    """The registered query: every document scored by the grammar alone, held-out rows and their accuracy."""
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = {r.doc_id: r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert set(out) == docs and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [i for i in toxic if out[i].held_out]
    assert np.mean([out[i].predicted == toxic[i] for i in held]) >= 0.95
    rude = [i for i in held if toxic[i]]
    assert rude and np.mean([out[i].predicted for i in rude]) >= 0.85  # what is always clean would not pass
    assert np.mean([out[i].predicted for i in held if not toxic[i]]) <= 0.02


def test_toxicity_of_ordinary_words(spark):
    """Trained on the given labels: stems are no beginnings of ordinary words; aimed finds, phrases and threats weigh no less than words alone."""
    sf = "/root/testdata/sf0.1"
    grammar = toxicity.train_on_labels(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = lambda text: float(grammar.scores(grammar.features(pa.array([text])))[0])
    for text in ("the path to the lake", "stupendous views", "it is worth a visit", "clowder of cats, a discgolf track, strasse", "he lost his keys", "", "do not kill the process"):
        assert score(text) < 0.5, text
    for text in ("you are a waste of space", "you pathetic loser", "such an utter idiot", "i will hurt you", "he is a moron"):
        assert score(text) >= 0.5, text
    assert score("you are an idiot") >= score("what an idiot") and score("such an utter idiot") >= score("what an idiot")
    assert score("he said you are an idiot") <= score("you are an idiot") >= score("you are not an idiot")
    w = grammar.weights[:-1]
    assert (w >= 0).all() and all(w[low] <= w[high] for low, high in toxicity.ORDER)


def test_longest_stems():
    assert toxicity.longest({"path": 50, "pathe": 50, "pathetic": 50, "vequ": 40, "vequa": 20, "lost": 30, "lostra": 29}, 0.95) == ["lostra", "pathetic", "vequ"]
    assert toxicity.longest({}, 0.95) == []


def test_toxicity_fit_is_the_best_in_order():
    """No other weights in order cost less: small moves that stay in order don't help."""
    rng = np.random.default_rng(2)
    x = np.log1p(rng.poisson(0.3, (300, len(toxicity.PATTERNS))))
    y = (x[:, 0] - x[:, 3] + rng.normal(0, 0.5, 300) > 0.2).astype(float)  # against the order: a target lowers
    times, prior = np.ones(300), toxicity.Grammar().weights
    cost = lambda w: (np.logaddexp(0, x @ w[:-1] + w[-1]) - y * (x @ w[:-1] + w[-1])).sum() + ((w - prior) ** 2).sum() / 2
    best = toxicity.fit(x, y, times, prior)
    ordered = lambda w: (w[:-1] >= 0).all() and all(w[low] <= w[high] for low, high in toxicity.ORDER)
    assert ordered(best) and best[3] == pytest.approx(best[0], abs=1e-2)
    for _ in range(3000):
        other = best + rng.normal(0, 10.0 ** rng.uniform(-3, 0), len(best)) * (rng.random(len(best)) < 0.2)
        assert not ordered(other) or cost(other) >= cost(best) - 0.02


def test_toxicity_from_text_to_score(spark):
    """Whole texts by a plain reader: clauses cut at marks, words of letters, digits and apostrophes, patterns found by looking around."""
    own = toxicity.Grammar({"vequ": toxicity.INSULT})
    rng = random.Random(4)
    some = "you idiot not said such an utter waste of space vequai LOSER i will kill them naïve don't x1".split()
    texts = ["".join(rng.choice(some) + rng.choice([" ", " ", " ", ", ", ". ", "!", "\n", ";", " - "]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["", " .. ", "idiot " * 2_000, "idiot. " * 300_000] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect() if r.text]
    got = own.scores(own.features(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        found = [p for clause in re.split(r"[.!?;:\n]", text) for p in brute.clause_patterns([w.lower() for w in re.findall(r"[0-9A-Za-z'\u0080-\U0010ffff]+", clause)], own.symbol, toxicity)]
        z = sum(own.weights[k] * np.log1p(found.count(p)) for k, p in enumerate(toxicity.PATTERNS)) + own.weights[-1]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), text[:80]


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(k, " ".join([word() for _ in range(30)] + (["zzgrowl" + rng.choice("aeiou")] if k % 4 == 0 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), None) for k in range(400)] + [(None, 1, None), (5, None, None)], "doc_id long, toxic int, quality int")
    grammar = toxicity.train_on_labels(frame(spark, docs), labels)
    out = {r.doc_id: r for r in toxicity.toxicity(frame(spark, docs), grammar).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(out[k].predicted == (k % 4 == 0) for k in held)
    assert all(0 <= r.score <= 1 for r in out.values())
    edge = toxicity.toxicity(frame(spark, REPEATED), grammar).collect()
    assert len(edge) == len(REPEATED)
    untrained = toxicity.train_on_labels(frame(spark, docs), labels.where("false"))
    assert (untrained.weights == toxicity.Grammar().weights).all()
    assert toxicity.drop_toxic(frame(spark, docs), grammar).count() == 300
    assert toxicity.toxicity(frame(spark, []), grammar).count() == 0


def test_held_out(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    assert {r.doc_id for r in ids.where(toxicity.held_out(F.col("doc_id"))).collect()} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    right = con.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(repr, df[list(right.columns)].astype(str).itertuples(index=False, name=None)))
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(right)


def test_pipeline_by_brute_force(spark):
    """Every stage against plain Python on the rows it got."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        pairs = [(i, r.text) for i, r in before.items()]
        docs = common.materialize(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            grammar = toxicity.train_on_labels(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = grammar.scores(grammar.features(pa.array([t for _, t in pairs])))
            assert set(after) == {i for (i, _), s in zip(pairs, scores, strict=True) if s < 0.5}
        elif name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {i: t for i, _, _, t in brute.line_dedup(pairs)}
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, _, _, g in brute.jaccard(pairs) if i == g}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in brute.decontaminate(pairs, items) if not r[5]}
        else:
            theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {(i, r.n_tokens) for i, r in after.items()} == {(i, len(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_jaccard_query(spark):
    out = queries.op2_ngram_jaccard_join(spark, SF)
    assert got(out, "doc_id", "class_id", "n_copies", "n_links", "group_id") == want(brute.jaccard(documents(spark)))


def test_tokenizer_queries(spark):
    """op5 and op8 with their production parameters, against the tokenizers library."""
    theirs, at, expected = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted(documents(spark)):
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(queries.op5_token_id_output(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == want(expected)
    theirs, expected = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    theirs.no_truncation()
    theirs.no_padding()
    for i, t in documents(spark):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(theirs.decode(ids, skip_special_tokens=False).encode())))
    assert got(queries.op8_bpe_encoding_decoding(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(expected)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and blank texts, repeated rows, ids with several texts and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in docs.orderBy("doc_id").limit(20).collect()]
    odd = [(None, None, None, None, None), (None, some[0][1], None, None, None), (900, "", "en", None, 0), (901, " \n\t ", None, "s", 5), (902, None, "en", "s", None), some[3], some[3], (some[4][0], "another text under this id", "en", "s", 26)]
    spark.createDataFrame(some + odd, docs.schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for where in ("odd", "none"):
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / where / f"{table}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = [r.doc_id for r in out]
    assert {900, 901, 902} <= set(ids) and None in ids and len(out) <= 28
    assert {r.n_tokens for r in out if r.doc_id in (900, 901, 902)} == {0}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
