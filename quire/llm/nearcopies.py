"""Near copies by word shingles: SimHash classes are verified, and what lies beyond them is found, by exact Jaccard similarity.

A text is the set of its shingles of ``SHINGLE`` words (its words as in ``simhash.fingerprint``; a shorter text is
one shingle); equal sets collapse to one node. The nodes of a class, whose SimHash fingerprints the trees of ``simhash`` have
linked, are compared with the class's smallest set. Unequal texts of similarity 0.8 differ in some ten of 64 bits, beyond the
radius of the trees; these links are completed as follows, where nodes that their class has linked already are not compared again. Nodes that share one of ``BANDS`` keys of ``ROWS`` minima each are
candidates; at similarity 0.8 a pair shares none with a chance of 3 in a million. A key's nodes are first
compared with the key's node of the smallest set, which links a group of near copies by as many pairs as it has members, then, as
far as they are not linked, with a few more nodes of small sets: where texts share one passage and nothing else, these
are like any that has a near copy. The nodes
of classes and keys whose members are still in several components are then joined by their rarest shingles: sets of a similarity of
0.8 share one of the rarest fifth of either, and the rarest one that they share leaves enough behind it. So unlike texts that met in a key by what many have in common, a licence or
a template, are not compared pair by pair. Every link is an exact similarity of ``PERCENT`` or more.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch
from quire.llm.components import connected_components

SHINGLE, PERCENT, BANDS, ROWS, SEED = 5, 80, 32, 5, 42
#: How many first nodes of a key meet its other ones, in the rounds after the first.
LEADERS = (8,)
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; empty if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, k, digest = b" ".join(words), min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def node_of(found: np.ndarray) -> int:
    """The signed long that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i : i + 512, None] * _FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, key: str, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """``key``, node, the size of its set, its ``fingerprint`` as a signed long and keys of every row of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
                columns = [part.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "node", "n", "fp", "keys"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, node long, n int, fp long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and its set for every row of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "found"])

    return docs.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, found array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets have a Jaccard similarity of PERCENT or more."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("found").alias("b")), "v")
    n, m = F.size("a"), F.size("b")
    near = both.where((n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT))
    shared = F.size(F.array_intersect("a", "b"))
    return near.where(shared * (100 + PERCENT) >= (n + m) * PERCENT).select("u", "v")


def rare_pairs(sets: DataFrame) -> DataFrame:
    """u, v of ``sets`` (node, label, found) of different labels that share one of the rarest shingles of both: all similar ones, and few others."""
    each = sets.select("node", "label", F.size("found").alias("n"), F.explode("found").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, "shingle")
    # those that no other set has are the rarest, and meet nothing; place counts from the rarest of all
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    place = alone + F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    heads = shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + 1)
    heads = heads.select("shingle", "node", "label", "n", (F.col("n") - F.col("place") + 1).cast("int").alias("rest"))
    one, other = heads.toDF("shingle", "u", "a", "n", "rest"), heads.toDF("shingle", "v", "b", "m", "tail")
    sizes = (F.col("n") * 100 >= F.col("m") * PERCENT) & (F.col("m") * 100 >= F.col("n") * PERCENT)
    # of the rarest shingle that two sets share, as many as are left from it on may be shared
    enough = F.least("rest", "tail") * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT
    met = (one["shingle"] == other["shingle"]) & (F.col("a") < F.col("b")) & sizes & enough
    return one.join(other, met).select("u", "v").distinct()


def _led(met: DataFrame) -> DataFrame:
    """``met`` (key, node, n) with its place among its key's nodes by their sets' size, of keys with several."""
    by_node = Window.partitionBy("key").orderBy("n", "node")
    placed = met.withColumns({"place": F.row_number().over(by_node), "members": F.count("*").over(Window.partitionBy("key"))})
    return placed.where("members > 1").drop("members")


def _headed(met: DataFrame) -> DataFrame:
    """``met`` (key, node, n, distinct) with the node and the size of its key's smallest set, of keys with several nodes."""
    heads = met.groupBy("key").agg(F.min(F.struct("n", "node")).alias("head"), F.count("*").alias("members")).where("members > 1").select("key", "head.*").toDF("key", "least", "head")
    return met.join(heads, "key")


def components(docs: DataFrame, signed: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """node -> rep: the smallest ``key`` of each group of near copies; ``docs`` has key and text, ``signed`` their signatures, ``classes`` the label of each fp.

    What has been linked to its class's first node, or to one of its key's, meets no further ones by keys, so the pairs of a round are a few
    for each node, however large a group of copies is.
    """
    rows = signed.count()
    nodes = scratch.materialize(signed.groupBy("node").agg(F.min(key).alias("rep")), "near-nodes", rows)
    classed = signed.select("fp", "node", "n").distinct().join(classes, "fp").select(F.col("label").alias("key"), "node", "n")
    classed = scratch.materialize(_headed(classed), "near-classed", rows)
    shared = scratch.materialize(_headed(signed.select(F.explode("keys").alias("key"), "node", "n").distinct()), "near-keys", rows)
    wanted = shared.select("node").union(classed.select("node")).distinct().join(nodes, "node").select("node", F.col("rep").alias(key))
    with scratch.text_batches(docs.sparkSession):
        sets = scratch.materialize(shingle_sets(docs.join(wanted, key)), "near-sets")
    # a key's nodes come in order of n, and a set that is too small for a similar one needs no comparison
    alike = lambda small: F.col(small) * 100 >= F.col("n") * PERCENT
    pairs_of = lambda headed: headed.where("node <> head").where(alike("least")).select(F.col("node").alias("u"), F.col("head").alias("v"))
    # a node has one class, so these links are stars around the classes' first nodes
    stars = scratch.materialize(similar(pairs_of(classed), sets), "near-stars", rows)
    ends = lambda end: stars.select(F.col("u").alias(end), F.col("v").alias(f"{end}_star"))
    apart = F.coalesce("u_star", "u") != F.coalesce("v_star", "v")
    first = pairs_of(shared).distinct().join(ends("u"), "u", "left").join(ends("v"), "v", "left").where(apart).select("u", "v")
    edges = scratch.materialize(stars.unionByName(similar(first, sets)), "near-edges", rows)
    used, left = [edges], shared.where("node <> head").select("key", "node", "n")
    for leaders in LEADERS:
        left = scratch.materialize(_led(left.join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti")), "near-left", rows)
        lead = left.where(F.col("place") <= leaders).select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("place").alias("before"))
        pairs = left.join(lead, "key").where("before < place").where(alike("m")).select(F.col("node").alias("u"), "v").distinct()
        edges = scratch.materialize(similar(pairs, sets), "near-edges", rows)
        used += [left, edges]
        left = left.where(F.col("place") > leaders).select("key", "node", "n")
    found = functools.reduce(DataFrame.unionByName, [used[0], *used[2::2]])
    begun = scratch.materialize(connected_components(found, rows), "near-groups", rows)
    grouped = shared.select("key", "node").union(classed.select("key", "node")).join(begun, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = grouped.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    pending = scratch.materialize(sets.join(grouped.join(mixed, "key").select("node", "label").distinct(), "node").select("node", "label", "found"), "near-pending")
    more = scratch.materialize(similar(rare_pairs(pending), sets), "near-more", rows)
    labels = connected_components(found.unionByName(more), rows).select("node", "label")
    linked = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = linked.groupBy("label").agg(F.min("rep").alias("least"))
    out = scratch.materialize(linked.join(least, "label").select("node", F.col("least").alias("rep")), "near-reps", rows)
    scratch.release(nodes, classed, shared, sets, stars, *used, begun, pending, more)
    return out
