"""Blobs in chunks, JSON documents in a key-value table with a time to live, and page caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, MAX_CHUNKS = 20 << 20, 40


def to_chunks(blobs: DataFrame, chunk_bytes: int = CHUNK_BYTES, max_bytes: int | None = None) -> DataFrame:
    """id, kind, idx, chunk of each blob (id, kind, data); blobs above ``max_bytes`` are left out whole."""
    kept = blobs.where(F.octet_length("data") <= max_bytes) if max_bytes is not None else blobs
    last = F.greatest(F.ceil(F.octet_length("data") / chunk_bytes).cast("int") - 1, F.lit(0))
    each = kept.select("id", "kind", "data", F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    return each.select("id", "kind", "idx", F.substring(F.col("data"), F.col("idx") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """id, kind, data: the chunks of a blob from the first on, as far as they follow each other."""
    items = chunks.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("idx", "chunk"))).alias("c"))
    follow = F.filter("c", lambda x, i: x.idx == i)
    return items.select("id", "kind", F.unhex(F.array_join(F.transform(follow, lambda x: F.hex(x.chunk)), "")).alias("data"))


def contiguous(chunks: DataFrame) -> DataFrame:
    """id, kind, n: how many chunks follow each other from the first, at most MAX_CHUNKS."""
    items = chunks.groupBy("id", "kind").agg(F.array_sort(F.collect_set("idx")).alias("c"))
    return items.select("id", "kind", F.least(F.size(F.filter("c", lambda x, i: x == i)), F.lit(MAX_CHUNKS)).alias("n"))


def put(table: DataFrame, writes: DataFrame) -> DataFrame:
    """The key-value table (key, value, version) after ``writes``: the last version of a key wins."""
    both = table.select("key", "value", "version").unionByName(writes.select("key", "value", "version"))
    return both.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def scan(table: DataFrame, prefix: str, now: Column, ttl_seconds: int, limit: int | None = None) -> DataFrame:
    """Rows whose key begins with ``prefix`` and whose version (seconds) is alive, the first ``limit`` by key."""
    rows = table.where(F.col("key").startswith(prefix) & (now - F.col("version") <= ttl_seconds))
    return rows.orderBy("key").limit(limit) if limit is not None else rows


def cached_pages(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and misses of ``pages`` (cache_key, page, texts) in ``cache``: a page counts only where all its texts are equal."""
    on = ["cache_key", "page", "texts"]
    return pages.join(cache.select(*on, "translations"), on), pages.join(cache.select(*on), on, "left_anti")


def write_cache(pages: DataFrame, path: str) -> None:
    """Write pages with their translations, each cache key a partition that replaces the one before."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)
