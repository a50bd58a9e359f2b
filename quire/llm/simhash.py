"""SimHash near-duplicates, found exactly with vantage-point trees.

Texts become 64-bit fingerprints; equal fingerprints collapse to one node. A
vantage-point tree over a bounded sample (``SAMPLE_PER_SHARD`` nodes a shard) cuts
Hamming space into shards. A node lives in one shard and is also sent, as a query,
to those shards that its ball of radius ``MAX_BITS`` touches by the triangle
bounds; of two shards only one direction is sent. A tree has ``MAX_SHARDS`` shards at
most, so that its broadcast is bounded; where that leaves shards too large, each of them
gets a tree of its own, which travels with the shard's rows, level by level. Inside a shard a local tree,
again with triangle bounds, meets all pairs, which are folded into a forest at
once: a shard emits at most one edge for each of its nodes, never its pairs.
Connected components join the shards' forests.

Defined results: text that is null or has no word gets fingerprint 0, linked like
any other. Rows of null doc_id are kept; the component is the smallest doc_id that
is not null, or null if there is none. Repeated rows are repeated in the result.
Empty tables give no rows; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import scratch
from quire.llm import nearcopies
from quire.llm.components import connected_components
from quire.llm.rows import steady

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Nodes that a shard holds about (one of over four times as many is cut again), sampled nodes for each shard, and most shards of one tree.
SHARD_NODES, SAMPLE_PER_SHARD, MAX_SHARDS = 2048, 16, 4096
LEAF, CELLS = 48, 1 << 19


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``; 0 if there is none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for i in range(0, batch.num_rows, 256):
                for k, text in enumerate(batch.column(1).slice(i, 256).to_pylist(), i):
                    fps[k] = fingerprint(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, fp long")


# --- the tree over shards --------------------------------------------------------------------


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius with points on either side, the most even of a few; None if all distances tie."""
    best = None
    for p in points[rng.integers(len(points), size=5)]:
        d = np.bitwise_count(points ^ p)
        mu = int(np.median(d))
        for radius in (mu, mu - 1):
            inside = int((d <= radius).sum())
            if 0 < inside < len(points) and (best is None or abs(2 * inside - len(points)) < best[0]):
                best = (abs(2 * inside - len(points)), p, radius)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Inner nodes (vantage point, radius, inside, outside), the root first; a child below 0 is the shard ~child."""
    rng, nodes, leaves = np.random.default_rng(7), [], [0]

    def grow(points: np.ndarray, want: int) -> int:
        cut = _split(points, rng) if want > 1 and len(points) > 1 else None
        if cut is None:
            leaves[0] += 1
            return ~(leaves[0] - 1)
        at = len(nodes)
        nodes.append(())
        inside = np.bitwise_count(points ^ cut[0]) <= cut[1]
        nodes[at] = (*cut, grow(points[inside], want // 2), grow(points[~inside], want - want // 2))
        return at

    grow(sample, shards)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, lives_here: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shard and whether it lives there, for the home of each fingerprint and the shards that its ball touches.

    Fingerprints that don't live here, queries from elsewhere, have no home and go to all shards that they touch.
    """
    rows, shards, home = [], [], []
    here = np.ones(len(fps), bool) if lives_here is None else lives_here
    stack = [(0 if nodes else ~0, np.arange(len(fps)), here)]
    while stack:
        at, idx, own = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            rows.append(idx)
            shards.append(np.full(len(idx), ~at))
            home.append(own)
            continue
        p, radius, inside, outside = nodes[at]
        d = np.bitwise_count(fps[idx] ^ p).astype(np.int64)
        near, far = d - MAX_BITS <= radius, d + MAX_BITS > radius
        stack += [(inside, idx[near], own[near] & (d <= radius)[near]), (outside, idx[far], own[far] & (d > radius)[far])]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    rows, shards, home = map(np.concatenate, (rows, shards, home))
    lives = np.zeros(len(fps), np.int64)
    lives[rows[home]] = shards[home]
    there = lives[rows]
    sent = home | ~here[rows] | np.where((there + shards) % 2 == 1, there < shards, there > shards)  # one direction of each two shards
    return rows[sent], shards[sent], home[sent]


# --- inside a shard --------------------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1 for arrays of pairs; roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (up := self.parent[r]) is not r and (up != r).any():
            r = up
        return r

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def join_shard(index: np.ndarray, queries: np.ndarray) -> Forest:
    """All pairs within MAX_BITS of index x (index + queries), as a forest over the positions of index, then queries."""
    everything = np.concatenate([index, queries])
    forest, rng = Forest(len(everything)), np.random.default_rng(11)
    stack = [(np.arange(len(index)), np.arange(len(everything)))]
    while stack:
        points, asks = stack.pop()
        if not len(points) or not len(asks):
            continue
        cut = _split(index[points], rng) if len(points) > LEAF else None
        if cut is None:
            step = max(1, CELLS // len(points))
            for i in range(0, len(asks), step):
                q, p = np.nonzero(np.bitwise_count(everything[asks[i : i + step], None] ^ index[points][None, :]) <= MAX_BITS)
                q, p = asks[i : i + step][q], points[p]
                forest.union(q[q != p], p[q != p])
            continue
        dp, dq = np.bitwise_count(index[points] ^ cut[0]), np.bitwise_count(everything[asks] ^ cut[0]).astype(np.int64)
        stack += [(points[dp <= cut[1]], asks[dq - MAX_BITS <= cut[1]]), (points[dp > cut[1]], asks[dq + MAX_BITS > cut[1]])]
    return forest


def _shard_edges(table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    home = table.column("home").to_numpy()
    index, queries = fps[home], fps[~home]
    forest = join_shard(index, queries)
    everything = np.concatenate([index, queries])
    roots = forest.roots(np.arange(len(everything)))
    linked = roots != np.arange(len(everything))
    return pa.table({"u": everything[linked].view(np.int64), "v": everything[roots[linked]].view(np.int64)})


ROUTED = "shard long, fp long, home boolean"


def _routed(shard: np.ndarray, fps: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(shard), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(shard[s].astype(np.int64)), pa.array(fps[s]), pa.array(home[s])], names=["shard", "fp", "home"])


def _uniform(level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shards"), F.lit(level), "fp"), F.lit(1 << 20)) / float(1 << 20)


def _first_level(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes in shards by one broadcast tree."""
    shards = min(MAX_SHARDS, max(1, n // SHARD_NODES))
    sample = nodes.where(_uniform(0) < SAMPLE_PER_SHARD * shards / max(n, 1)).select("fp").collect() if shards > 1 else []  # about 64 thousand longs at most
    tree = nodes.sparkSession.sparkContext.broadcast(build_tree(np.sort(np.array([r.fp for r in sample], np.int64)).view(np.uint64), shards) if sample else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64)
            rows, shard, home = route(tree.value, fps.view(np.uint64))
            yield from _routed(shard, fps[rows], home)

    return nodes.select("fp").mapInArrow(run, ROUTED)


def _next_level(routed: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """Cut the ``large`` shards (shard, n) again; a shard's tree goes first among its rows, which stream behind it."""
    nodes, most = SHARD_NODES, MAX_SHARDS

    def tree_of(table: pa.Table) -> pa.Table:
        fps, n = np.sort(table.column("fp").to_numpy().astype(np.int64)).view(np.uint64), table.column("n")[0].as_py()
        flat = np.array([(np.uint64(p).view(np.int64), radius, inside, outside) for p, radius, inside, outside in build_tree(fps, min(most, n // nodes))], np.int64)
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([flat.tobytes()], pa.binary())})

    rate = SAMPLE_PER_SHARD * F.least(F.lit(MAX_SHARDS), F.col("n") / SHARD_NODES) / F.col("n")
    sample = routed.where("home").join(large, "shard").where(_uniform(level) < rate).select("shard", "fp", "n")
    trees = sample.groupBy("shard").applyInArrow(tree_of, "shard long, tree binary")
    marked = routed.withColumn("tree", F.lit(None).cast("binary")).unionByName(trees.select("shard", F.lit(None).cast("long").alias("fp"), F.lit(None).cast("boolean").alias("home"), "tree"))
    ordered = marked.repartition("shard").sortWithinPartitions("shard", F.col("tree").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.nonzero(shards[1:] != shards[:-1])[0] + 1).tolist(), len(shards)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if shards[i] != at:
                    at, tree = shards[i], []
                flat = batch.column("tree")[i].as_py()
                if flat is not None:
                    tree = [(np.int64(p).view(np.uint64), r, a, b) for p, r, a, b in np.frombuffer(flat, np.int64).reshape(-1, 4).tolist()]
                    i += 1
                fps, home = batch.column("fp").slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("home").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                rows, shard, lives = route(tree, fps.view(np.uint64), home)
                yield from _routed(at * most + shard, fps[rows], lives)

    return ordered.mapInArrow(run, ROUTED)


def link(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of ``nodes`` (fp, distinct) within MAX_BITS of each other."""
    n = nodes.count()
    routed = _first_level(nodes, n)
    if n > MAX_SHARDS * SHARD_NODES:
        before = n
        for level in range(1, 5):
            routed = scratch.materialize(routed, "simhash-routed")
            # shards beyond a level's bound; there are at most n / (4 SHARD_NODES) of them, a row each
            large = scratch.materialize(routed.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 4 * SHARD_NODES), "simhash-large")
            most = large.agg(F.max("n")).first()[0]
            if most is None or most >= before:
                break  # none is left, or equal distances alone
            before = most
            routed = _next_level(routed, large, level)
    return routed.groupBy("shard").applyInArrow(_shard_edges, "u long, v long")


def classes(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp, rep (its smallest ``key``) and label (the class of all fingerprints reachable) of each distinct fingerprint of ``fps`` (key, fp)."""
    rows = fps.count()
    nodes = scratch.materialize(fps.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-nodes", rows)
    labels = connected_components(link(nodes), rows).select(F.col("node").alias("fp"), "label")
    return nodes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))


def components(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp -> rep: the smallest ``key`` reachable from each distinct fingerprint of ``fps`` (key, fp)."""
    linked = classes(fps, key)
    least = linked.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return linked.join(least, "label", "left").select("fp", F.coalesce("least", "rep").alias("rep"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = scratch.materialize(fingerprints(docs), "simhash")
    found = fps.join(components(fps), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep").alias("component_id"))


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (shingles of five words, similarity 0.8 or more): the smallest doc_id, or the first of its rows where doc_ids repeat or are null.

    SimHash fingerprints of the shingles meet in the vantage-point trees, as in op5; ``nearcopies`` verifies what met and finds
    the links whose fingerprints lie further apart.

    ``docs`` is read more than once; what is no plain scan of files is written first, so that row numbers stay.
    """
    docs = steady(docs)
    rid = F.monotonically_increasing_id()
    own = docs.select(rid.alias("rid"), "doc_id", "text")
    # rows in order of doc_id, those without one last; rid tells repeated rows apart
    keyed = own.select("rid", "text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("k"))
    with scratch.text_batches(spark):
        signed = scratch.materialize(nearcopies.signatures(keyed, "k", majority), "near")
    keep = nearcopies.components(keyed, signed, classes(signed.select("k", "fp"), "k"), "k").select(F.col("rep.rid").alias("rid")).distinct()
    held = docs.select(rid.alias("rid"), F.struct("*").alias("row")).join(keep, "rid", "left_semi")
    return held.select(*[F.col(f"row.`{c}`") for c in docs.columns])
