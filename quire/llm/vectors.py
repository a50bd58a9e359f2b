"""What the vector searches share: clean rows, blocks of queries, and merging of top-k lists.

The stated queries become rows of about ``BLOCK_BYTES`` of vectors. One job pairs each
block with each row of the index (a shard or bucket); Spark broadcasts the blocks where
their table is below its own threshold and takes the product of partitions beyond it.
No vector passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch

#: Bytes of query vectors in a block, and of blocks whose lists a task holds at once.
BLOCK_BYTES, HELD_BYTES = 1 << 20, 32 << 20


def clean(table: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that have a vec_id and only finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column, all of length ``dim``, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors of the rows of each vector length."""
    column = batch.column("v")
    sizes = np.asarray(column.value_lengths()) if isinstance(column, pa.Array) else np.concatenate([np.asarray(c.value_lengths()) for c in column.chunks]) if column.num_chunks else np.zeros(0, int)
    ids = np.asarray(batch.column("vec_id"), np.int64)
    for dim in np.unique(sizes):
        at = np.nonzero(sizes == dim)[0]
        yield int(dim), ids[at], matrix(column.take(pa.array(at)), int(dim))


def query_blocks(rows: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """q_dim, q_ids, q_data of blocks of the rows (vec_id, v), a vector length to a block."""
    size = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, data, _ = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary())], names=["q_dim", "q_ids", "q_data"])

        for batch in batches:
            for dim, ids, data in by_dim(batch):
                step = max(1, size // (8 * dim))
                for i in range(0, len(ids), step):
                    a, b, n = held.get(dim, ([], [], 0))
                    held[dim] = (a + [ids[i : i + step]], b + [data[i : i + step]], n + len(ids[i : i + step]))
                    if held[dim][2] >= step:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return rows.select("vec_id", "v").mapInArrow(run, "q_dim int, q_ids binary, q_data binary")


class TopK:
    """The k best (score, then smaller id) of each of n queries."""

    def __init__(self, n: int, k: int, kind: type = np.float64) -> None:
        self.n, self.k, self.begun = n, k, False
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        #: The k-th best score of a query; where it has fewer, the least value.
        self.floor = np.full(n, np.iinfo(np.int64).min + 1 if kind is np.int64 else -np.inf, kind)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score.astype(self.score.dtype)]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.floor[row[last]] = score[last]


def search(index: DataFrame, queries: DataFrame, meet: Callable[[dict, np.ndarray, np.ndarray, TopK], None], kind: type, k: int, label: str) -> DataFrame:
    """query_id, rank, vec_id, score: every block of queries meets every row of ``index``, which has dim among its columns.

    ``meet(row, ids, vectors, best)`` offers what a row of the index has to the block's lists. A task's partial lists, at
    most k a query, meet in a last top-k.
    """
    score_type, names = ("long" if kind is np.int64 else "double"), index.columns
    blocks = scratch.materialize(query_blocks(queries).withColumn("block", F.monotonically_increasing_id()), f"{label}-queries")

    def lists(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for ids, _, best in held.values():
            if len(best.row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.row]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                if value("dim") != value("q_dim"):
                    continue
                block = value("block")
                if block not in held:
                    if size >= HELD_BYTES:
                        yield from lists(held)
                        held, size = {}, 0
                    ids, q = np.frombuffer(value("q_ids"), np.int64), np.frombuffer(value("q_data"), np.float64).reshape(-1, value("q_dim"))
                    held[block] = ids, q, TopK(len(ids), k, kind)
                    size += q.nbytes
                meet({c: value(c) for c in names}, *held[block])
        yield from lists(held)

    schema = f"query_id long, vec_id long, score {score_type}"
    found = scratch.materialize(index.crossJoin(blocks).mapInArrow(run, schema), label)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
