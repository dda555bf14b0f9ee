"""Benchmark decontamination with DataFrame functions only.

Benchmark texts and documents are normalised to lower-case words. Each benchmark item gives its windows of ten words
(or itself, if shorter); the hash table of these windows is broadcast while it is small enough, checked by counting, and else
joined by shuffle, of hashes and places alone. Document windows are probed by hash and every hit is verified on the words themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, materialize

#: What parts words once A-Z are lower case: every ASCII byte but digits and a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ID, TEXT_HASH = "__loom_id", "__loom_text"


def normalised_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def _windows(words: Column, length: Column | int) -> Column:
    """Hashes of all windows; none if there are fewer words."""
    count = F.greatest(F.size(words) - length + 1, F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, length)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """h, words, len, items: every different window of the benchmark and the items (as strings) it comes from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normalised_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = items.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), "w")
    each = cut.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return each.groupBy("len", "words").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items")).select(F.xxhash64("words").alias("h"), "words", "len", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 200_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any benchmark window), n_items, items_sha256, contaminated, and the
    hit positions as ``hits`` (sorted array of word positions from 1).

    Null and empty texts have no words and no hits, and null or wordless benchmark items no windows; with an empty benchmark
    nothing is hit. A null item_id counts as an item with the empty name. A null doc_id is kept. Rows that agree in doc_id and text give
    one row each, with the same values. The benchmark is broadcast only while it has at most ``broadcast_rows`` windows of
    ``broadcast_bytes`` in all. Windows of fewer words than n come from items that short; all their lengths are probed in one further scan."""
    table = materialize(benchmark_windows(benchmark, n), "benchmark")
    held = F.sum(64 + F.length(F.array_join("words", " ")) + F.length(F.array_join("items", " ")) + 16 * (F.size("words") + F.size("items")))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(held, F.lit(0)).alias("bytes"), F.sort_array(F.collect_set(F.when(F.col("len") < n, F.col("len")))).alias("lengths")).first()  # n - 1 lengths at most
    small = size["rows"] <= broadcast_rows and size["bytes"] <= broadcast_bytes
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias(TEXT_HASH), normalised_words(F.col("text")).alias("w"))

    def probe(lengths: list[int], outer: bool, *carried: str) -> DataFrame:
        each = words.select("doc_id", TEXT_HASH, F.size("w").alias("n_words"), *carried, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _windows(F.col("w"), k).alias("hs")) for k in lengths])).alias("each"))
        return each.select("doc_id", TEXT_HASH, "n_words", *carried, "each.k", (F.posexplode_outer if outer else F.posexplode)("each.hs").alias("at", "wh"))

    # kept as a test of found rows: as an equality it would become a join key, for which every window's words are copied and hashed
    agrees = F.array_position(F.array("words"), F.slice("w", F.col("at") + 1, F.col("k"))) > 0
    same = (F.col("wh") == F.col("h")) & (F.col("k") == F.col("len"))
    hit = F.sequence(F.col("at") + 1, F.col("at") + F.col("k")).alias("hit")

    def scan(lengths: list[int], outer: bool) -> DataFrame:
        """With a broadcast table, in one pass; with ``outer`` one row a document at least, marked as its head."""
        known = F.broadcast(table.where(F.col("len").isin(lengths)))
        found = probe(lengths, outer, "w").join(known, same & agrees, "left" if outer else "inner")
        head = F.lit(outer) & F.coalesce(F.col("at") == 0, F.lit(True))
        if outer:
            found = found.where(F.col("items").isNotNull() | head)
        return found.select("doc_id", TEXT_HASH, "n_words", head.alias("head"), F.when(F.col("items").isNotNull(), hit).alias("hit"), "items")

    def meet(lengths: list[int]) -> DataFrame:
        """By shuffle: windows travel as hashes, what is found meets its document's words again."""
        found = probe(lengths, False).join(table.where(F.col("len").isin(lengths)).hint("merge"), same)
        texts = words.select("doc_id", TEXT_HASH, "w").dropDuplicates(["doc_id", TEXT_HASH]).select(F.col("doc_id").alias("its_id"), F.col(TEXT_HASH).alias("its_text"), "w")
        sure = found.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col(TEXT_HASH) == F.col("its_text"))).where(agrees)
        return sure.select("doc_id", TEXT_HASH, "n_words", F.lit(False).alias("head"), hit, "items")

    if small:
        hits = scan([n], True)
        if size["lengths"]:
            hits = hits.unionByName(scan(list(size["lengths"]), False))
    else:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("hit", "array<int>"), ("items", "array<string>"))]
        hits = words.select("doc_id", TEXT_HASH, F.size("w").alias("n_words"), F.lit(True).alias("head"), *none).unionByName(meet([n, *size["lengths"]]))
    merged = hits.groupBy("doc_id", TEXT_HASH).agg(
        F.count_if("head").alias("rows"),  # rows that agree in id and text
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = merged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return merged.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits", TEXT_HASH,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no benchmark window hits."""
    bad = decontaminate(docs, benchmark, n).where("contaminated").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(ID), TEXT_HASH).distinct()
    keyed = docs.withColumns({ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), TEXT_HASH: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(bad, [ID, TEXT_HASH], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
