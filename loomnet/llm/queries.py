"""One registered query per operator: its production parameters over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.llm.additive_search import additive_search
from loomnet.llm.bpe import bpe
from loomnet.llm.decontamination import decontaminate
from loomnet.llm.hard_negatives import hard_negatives
from loomnet.llm.jaccard_join import jaccard_join
from loomnet.llm.line_dedup import line_dedup
from loomnet.llm.spelling_variants import spelling_variants
from loomnet.llm.substring_dedup import substring_dedup
from loomnet.llm.suffix_dedup import suffix_dedup
from loomnet.llm.token_counts import token_counts
from loomnet.llm.token_store import token_ids
from loomnet.llm.toxicity import held_out, toxicity, train_on_labels
from loomnet.llm.url_filters import url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = train_on_labels(docs, _read(spark, sf_dir, "labels"))
    return toxicity(docs, grammar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "matches")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"), window=13)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents"), length=400)


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), lines=3)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The dated block list of op10: list, pattern, action, date.
LIST_ENTRIES = [
    ("spam", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "spam-farm.example.org", "remove", "2024-07-01"),
    ("spam", "spam-farm.example.org", "add", "2024-09-15"),
    ("pharma", "cheap-pills.example.com", "add", "2024-01-10"),
    ("pharma", "cheap-pills.example.com", "remove", "2025-03-01"),
    ("casino", "casino.example.net", "add", "2024-04-01"),
    ("tracking", "example.net/en", "add", "2024-06-01"),
    ("tracking", "example.net/en", "remove", "2024-08-01"),
    ("mobile", "m.ththth.example.net", "add", "2024-03-01"),
    ("pages", "example.org/fr/414", "add", "2024-01-01"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so captures are dated from their id: seven hours on for each, over two years from 2024."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7, F.lit(17520)) * 3600).cast("timestamp_ntz").alias("fetched_at"))
    log = spark.createDataFrame(LIST_ENTRIES, "list_name string, pattern string, action string, day string")
    return url_filter(pages, log.select("list_name", "pattern", "action", F.to_timestamp_ntz("day").alias("listed_at")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled, positives=5, negatives=5, lower=80, upper=100, scale=256)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"), least=7, occurrences=2, times=10, damage=31)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: hash(w[k : k + 4])) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END)) AS s FROM words
), classes AS (
  SELECT s, min(doc_id) AS class_id, count(*) AS n_copies FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reach(id, other) AS (SELECT class_id, class_id FROM classes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
groups AS (SELECT id AS class_id, min(other) AS group_id FROM reach GROUP BY id), degree AS (SELECT a AS class_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(group_id, doc_id) AS group_id
FROM sets LEFT JOIN classes USING (s) LEFT JOIN degree USING (class_id) LEFT JOIN groups USING (class_id)
"""

OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS ws
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT ws, min(doc_id) AS first_id FROM windows GROUP BY ws HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (ws) WHERE doc_id > first_id
), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string([w[k] for k in range(1, len(w) + 1) if ps IS NULL OR NOT list_contains(ps, k)], ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS ws FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), lens AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS ws
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN grams USING (n, ws)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(ls, i, i + 2) AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM cut WHERE len(ls) >= 3)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY ws ORDER BY doc_id, i) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM ranked WHERE nth > 1),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string([ls[k] for k in range(1, len(ls) + 1) if ps IS NULL OR NOT list_contains(ps, k)], chr(10))) AS kept_sha256
FROM cut LEFT JOIN lost USING (doc_id)
"""

# windows are cut from short pieces of a text, as DuckDB walks a string from its beginning
OP9_SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, s + p AS p, hash(part[2 * p + 1 : 2 * p + 800]) AS a FROM (SELECT doc_id, s, part, unnest(range(len(part) // 2 - 399)) AS p FROM (
    SELECT doc_id, s, h[2 * s + 1 : 2 * s + 1198] AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399, 200)) AS s FROM bytes WHERE len(h) >= 800)))
), starts AS (
  SELECT doc_id, p FROM windows JOIN (SELECT a FROM windows GROUP BY a HAVING count(*) > 1) USING (a)
), spans AS (
  SELECT doc_id, min(p) AS b, max(p) + 400 AS e FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts))
  GROUP BY doc_id, run
), gone AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM spans GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN bs IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(bs) + 2), lambda k:
         h[2 * coalesce(es[k - 1], 0) + 1 : 2 * coalesce(bs[k], len(h) // 2)]), '') END)) AS kept_sha256
FROM bytes LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = (
    r"""
WITH entries(list_name, pattern, action, listed_at) AS (VALUES """
    + ", ".join(f"('{n}', '{p}', '{a}', TIMESTAMP '{d}')" for n, p, a, d in LIST_ENTRIES)
    + r"""), intervals AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY list_name, pattern ORDER BY listed_at) AS valid_to FROM entries
), active AS (SELECT list_name, pattern, listed_at AS valid_from, valid_to FROM intervals WHERE action = 'add'),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(((page_id * 7) % 17520)::INT) AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '\.$', '') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages
)
SELECT page_id, url, fetched_at, host, count(list_name) AS n_active,
       coalesce(string_agg(DISTINCT list_name, ',' ORDER BY list_name), '') AS lists, count(list_name) > 0 AS blocked
FROM captures LEFT JOIN active ON (
  ('.' || host || '/') LIKE ('%.' || split_part(pattern, '/', 1) || '/')
  AND (NOT contains(pattern, '/') OR (path || '/') LIKE (substr(pattern, strpos(pattern, '/')) || '/%'))
  AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
GROUP BY page_id, url, fetched_at, host
"""
)

OP11_SQL = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
           CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), without AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.next
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word) WHERE walk.next IS NULL
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_additive_search": op4_additive_search,
    "op5_token_id_output": op5_token_id_output,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe_encoding_decoding": op8_bpe_encoding_decoding,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op10_url_filters": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
