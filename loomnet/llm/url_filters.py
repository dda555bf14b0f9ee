"""URL filters as a temporal list join, with DataFrame functions only.

A list is a log of dated entries: (list_name, pattern, action 'add' or 'remove', listed_at). A pattern is a domain, which takes in its
subdomains, or a domain with a path, which takes in what lies below the path. The log becomes validity intervals: an entry holds from its date
until the next entry of the same list and pattern. Every capture is evaluated against the entries that were active when it was
fetched, by an equality join on its domain suffixes and path prefixes plus the interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomnet.llm.common import materialize


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and last dot; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """list_name, pattern, valid_from, valid_to (null: open) of every interval in which an entry is active.

    Entries with a null pattern, date or action are void. Of entries with one list, pattern and date a removal wins."""
    log = entries.where("pattern is not null and listed_at is not null and action in ('add', 'remove')")
    log = log.groupBy(F.coalesce("list_name", F.lit("")).alias("list_name"), F.lower(F.regexp_replace("pattern", r"/+$", "")).alias("pattern"), "listed_at").agg(F.max("action").alias("action"))
    until = F.lead("listed_at").over(W.partitionBy("list_name", "pattern").orderBy("listed_at"))
    return log.withColumn("valid_to", until).where("action = 'add'").select("list_name", "pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, broadcast_rows: int = 200_000, broadcast_bytes: int = 50_000_000) -> DataFrame:
    """Per capture (page_id, url, fetched_at): host, n_active (entries that match and are active then), lists (their list names,
    sorted and comma-joined) and blocked (n_active > 0).

    A null or malformed url has host '' and matches nothing, and so does a capture without a date; an empty list
    blocks nothing. Matching ignores the case of host and path. Rows that agree in page_id, url and date give one row each. Entries are broadcast only
    while they make at most ``broadcast_rows`` intervals of ``broadcast_bytes`` in all; otherwise the join is by shuffle, in which Spark splits hot keys.
    A capture is probed with as many labels of its host and steps of its path as the longest pattern has, so a very long url costs no more than others."""
    active = materialize(validity(entries), "intervals")
    steps_in = F.size(F.split("pattern", "/")) - 1
    size = active.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("pattern") + F.length("list_name") + 40), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(steps_in), F.lit(0)).alias("steps"), F.coalesce(F.max(F.size(F.split(F.split("pattern", "/")[0], r"\."))), F.lit(0)).alias("labels"),
    ).first()
    if size["rows"] <= broadcast_rows and size["bytes"] <= broadcast_bytes:
        active = F.broadcast(active)
    rows = captures.select("page_id", "url", F.col("fetched_at"), F.monotonically_increasing_id().alias("__row"), host_of(F.col("url")).alias("host"), F.lower(path_of(F.col("url"))).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - size["labels"] + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.slice(F.filter(F.split("path", "/"), lambda s: s != ""), 1, size["steps"])
    below = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    paths = F.concat(F.array(F.lit("")), below)
    keys = F.flatten(F.transform("suffixes", lambda s: F.transform("paths", lambda p: F.concat(s, p))))
    probes = rows.withColumns({"suffixes": suffixes, "paths": paths}).select("page_id", "url", "fetched_at", "__row", "host", F.explode(F.array_distinct(keys)).alias("pattern"))
    met = probes.join(active.withColumnRenamed("pattern", "listed"), (F.col("pattern") == F.col("listed")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))), "left")
    return met.groupBy("page_id", "url", "fetched_at", "host", "__row").agg(F.count("listed").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists")).select(
        "page_id", "url", "fetched_at", "host", "n_active", "lists", (F.col("n_active") > 0).alias("blocked")
    )
