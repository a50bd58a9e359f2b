"""Exact top-k inner products by norm buckets.

Vectors are range-partitioned by falling length and cut into buckets of at most
``BUCKET`` rows. A task meets its buckets longest first and keeps each query's
running k-th best score, seeded from the bucket of the longest vectors of all. For
a query and a bucket the local cosine threshold t = floor / (|q| * longest) decides:
above 1 the bucket is skipped; from ``COORD_COSINE`` on, coordinate pruning keeps the
rows whose values on the query's ``COORDS`` largest coordinates lie in the ranges
that a cosine of t allows; else length pruning keeps the rows with
|x| >= floor / |q|. What is left is verified with exact products. All bounds leave a
margin for rounding, so they only ever keep too much.

Defined results: a vector that is null, empty, or holds a null or non-finite
component takes no part, nor does a row without vec_id. Products are taken between
vectors of one length only. Repeated query ids are one query each, and equal results
of theirs collapse; a row never answers a query of its own vec_id. Ties go to the
smaller vec_id. Products beyond 64 bits saturate. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import scratch
from quire.llm import vectors
from quire.llm.vectors import TopK

BUCKET, K, EVERY, SCALE = 4096, 5, 50, 256
COORD_COSINE, COORDS = 0.8, 4
EXACT, LONG = 2.0**52, (1 << 63) - 1
QUERY_ROWS = 1024


def quantize(table: DataFrame) -> DataFrame:
    """v becomes floor(SCALE * x), still as doubles, which hold these integers exactly."""
    scaled = F.transform("v", lambda x: x * float(SCALE))
    rounded = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return vectors.clean(table).select("vec_id", rounded.alias("v"))


def buckets(rows: DataFrame) -> DataFrame:
    """longest, dim, ids, data of each bucket; rows in falling order of length."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ordered = rows.withColumn("length", length).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, data, _ = held.pop(dim)
            data = np.concatenate(data)
            longest = float(np.sqrt((data * data).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["longest", "dim", "ids", "data"])

        for batch in batches:
            for dim, ids, data in vectors.by_dim(batch):
                for i in range(0, len(ids), BUCKET):
                    a, b, n = held.get(dim, ([], [], 0))
                    part = ids[i : i + BUCKET]
                    held[dim] = (a + [part], b + [data[i : i + BUCKET]], n + len(part))
                    if held[dim][2] >= BUCKET:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return ordered.select("vec_id", "v").mapInArrow(cut, "longest double, dim int, ids binary, data binary")


class Bucket:
    def __init__(self, ids: bytes, data: bytes, dim: int) -> None:
        self.ids, self.x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
        length = np.sqrt((self.x * self.x).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.x, self.length = self.ids[order], self.x[order], length[order]
        self.longest = float(self.length[0])
        self.most = float(np.abs(self.x).max())


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(c) for c in r] for r in m], object) for m in (q, x))
    return np.array([[max(-LONG, min(LONG, sum(i * j for i, j in zip(r, s, strict=True)))) for s in b] for r in a], np.int64)


def _offer(best: TopK, rows: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Offer a block of scores (rows x ids); only those that reach the k-th best of the block or of before."""
    least = best.floor[rows]
    if scores.shape[1] > best.k + 1:
        # one more than k, since a query's own row is there too
        least = np.maximum(least, np.partition(scores, -(best.k + 1), axis=1)[:, -(best.k + 1)])
    r, c = np.nonzero(scores >= least[:, None])
    other = own[r] != ids[c]
    r, c = r[other], c[other]
    best.add(rows[r], scores[r, c], ids[c])


def search_bucket(bucket: Bucket, q_ids: np.ndarray, q: np.ndarray, q_len: np.ndarray, best: TopK) -> None:
    floor = best.floor.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(floor <= 0, -1.0, floor / (q_len * bucket.longest)) * (1 - 1e-9)
    t = np.where(np.isnan(t), -1.0, t)
    for row in np.nonzero((t >= COORD_COSINE) & (t <= 1))[0]:
        at = _coordinate_range(bucket, q[row] / q_len[row], float(t[row]))
        if len(at):
            _offer(best, np.array([row]), q_ids[row : row + 1], products(q[row : row + 1], bucket.x[at]), bucket.ids[at])
    by_length = np.nonzero(t < COORD_COSINE)[0]
    for i in range(0, len(by_length), QUERY_ROWS):
        rows = by_length[i : i + QUERY_ROWS]
        positive = floor[rows] > 0
        need = np.divide(floor[rows], q_len[rows], out=np.zeros(len(rows)), where=positive & (q_len[rows] > 0)).min() * (1 - 1e-9)
        n = int(np.searchsorted(-bucket.length, -need, side="right"))
        if n:
            _offer(best, rows, q_ids[rows], products(q[rows], bucket.x[:n]), bucket.ids[:n])


def _coordinate_range(bucket: Bucket, unit: np.ndarray, t: float) -> np.ndarray:
    """Rows that a cosine of t or more with ``unit`` allows, by its largest coordinates."""
    keep = np.arange(len(bucket.ids))
    for f in np.argsort(-np.abs(unit))[:COORDS]:
        x = bucket.x[keep, f] / np.maximum(bucket.length[keep], 1e-300)
        slack = np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - t * t)) + 1e-9
        keep = keep[np.abs(x - unit[f] * t) <= slack] if abs(unit[f]) <= t else keep[x * np.sign(unit[f]) >= abs(unit[f]) * t - slack]
        if not len(keep):
            break
    return keep


def top_products(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each of ``queries`` with ``rows`` (both vec_id, v of integers)."""
    index = scratch.materialize(buckets(rows), "mips")
    seed = [(r.dim, bytes(r.ids), bytes(r.data)) for r in index.orderBy(F.desc("longest")).limit(1).collect()]  # one bucket, of BUCKET rows at most
    shared = index.sparkSession.sparkContext.broadcast(seed)

    def meet(row: dict, ids: np.ndarray, q: np.ndarray, best: TopK) -> None:
        length = np.sqrt((q * q).sum(axis=1))
        own = (row["dim"], row["ids"], row["data"])
        if not best.begun:
            best.begun = True
            for dim, *x in shared.value:
                if dim == row["dim"]:
                    search_bucket(Bucket(*x, dim), ids, q, length, best)
        if own not in shared.value:
            search_bucket(Bucket(row["ids"], row["data"], row["dim"]), ids, q, length, best)

    return vectors.search(index.select("dim", "ids", "data"), queries, meet, np.int64, k, "mips-found")


def op10_exact_mips(spark, sf_dir: str) -> DataFrame:
    rows = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_products(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
