"""Sequential operators: greedy batches, rate limits, circuit breakers, last-kept dedupe, units of lines.

Each is a walk over the ordered rows of one key. Rows are partitioned by key and sorted within
partitions, so a task sees a key's rows one after another and keeps the walk's state alone: its
time grows with the rows, and a key may have more rows than fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 8192


def fold(rows: DataFrame, key: str, order: list[str], values: list[str], start: Callable[[], tuple], step: Callable[..., tuple], outputs: str) -> DataFrame:
    """``key``, the order columns and one output of ``step`` for each row.

    ``step(state, *row)`` gives the next state and the output for a row of the order columns and ``values``;
    ``start()`` is the state before a key's first row. ``outputs`` is the output's DDL.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *order]) + f", {outputs}"
    name, kind = outputs.split()
    arrow = {"boolean": pa.bool_(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None  # no key is equal to this one
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(i, ROWS), []
                keys, *columns = (c.to_pylist() for c in part.columns)
                for k, *row in zip(keys, *columns, strict=True):
                    if k != at:
                        at, state = k, start()
                    state, result = step(state, *row)
                    out.append(result)
                yield pa.RecordBatch.from_arrays([*part.columns[: 1 + len(order)], pa.array(out, arrow)], names=[key, *order, name])

    ordered = rows.select(key, *order, *values).repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, schema)


def greedy_batches(units: DataFrame, max_units: int, max_chars: int, after: bool = False) -> DataFrame:
    """doc_id, k, batch for units (doc_id, k, n): a batch closes before it would go beyond a limit, or ``after`` it has reached one."""

    def step(state: tuple, _: int, n: int) -> tuple:
        batch, count, chars = state
        full = count >= max_units or chars >= max_chars if after else count > 0 and (count + 1 > max_units or chars + n > max_chars)
        return ((batch + 1, 1, n) if full else (batch, count + 1, chars + n)), batch + full

    return fold(units, "doc_id", ["k"], ["n"], lambda: (0, 0, 0), step, "batch long")


def balanced_batches(units: DataFrame, max_units: int, max_chars: int) -> DataFrame:
    """doc_id, k, batch for units (doc_id, k, n): what remains at each batch's start is dealt evenly; a batch closes early before it would go beyond ``max_chars``."""

    def step(state: tuple, _: int, n: int, remain: int) -> tuple:
        batch, count, chars, take = state
        if count >= take or (count > 0 and chars + n > max_chars):
            return (batch + 1, 1, n, -(-remain // -(-remain // max_units))), batch + 1
        return (batch, count + 1, chars + n, take), batch

    rows = units.select("doc_id", "k", F.col("n").cast("long").alias("n"), (F.count("*").over(Window.partitionBy("doc_id")) - F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) + 1).alias("remain"))
    return fold(rows, "doc_id", ["k"], ["n", "remain"], lambda: (-1, 0, 0, 0), step, "batch long")


def accumulate_pages(pages: DataFrame, at_least: int = 30) -> DataFrame:
    """doc_id, k, batch for pages (doc_id, k, n units): pages gather until they have ``at_least`` units."""

    def step(state: tuple, _: int, n: int) -> tuple:
        batch, units = state
        return ((batch + 1, n), batch + 1) if units >= at_least else ((batch, units + n), batch)

    return fold(pages, "doc_id", ["k"], ["n"], lambda: (0, 0), step, "batch long")


def merge_units(lines: DataFrame, max_lines: int = 12, max_chars: int = 1500) -> DataFrame:
    """doc_id, k, unit for lines (doc_id, k, n characters, follows, glue): a line that follows joins its unit until a cap is reached.

    ``glue`` is what joining adds: one character for a blank, or less one for a hyphen that goes.
    """

    def step(state: tuple, _: int, n: int, follows: bool, glue: int) -> tuple:
        unit, count, chars = state
        if follows and 0 < count < max_lines and chars + glue + n <= max_chars:
            return (unit, count + 1, chars + glue + n), unit
        return (unit + 1, 1, n), unit + 1

    return fold(lines, "doc_id", ["k"], ["n", "follows", "glue"], lambda: (-1, 0, 0), step, "unit long")


def rate_limit(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, t, id, over for hits (user_id, t seconds, id): a window opens at the first hit after the last has run out."""

    def step(state: tuple, t: int, _: int) -> tuple:
        since, n = state
        if since is None or t - since > seconds:
            since, n = t, 0
        return (since, n + 1), n + 1 > most

    return fold(hits, "user_id", ["t", "id"], [], lambda: (None, 0), step, "over boolean")


def circuit_breaker(calls: DataFrame, strikes: int = 2, cooldown: int = 120) -> DataFrame:
    """user_id, t, id, cooling for calls (user_id, t, id, failed): ``strikes`` failures in a row cool a channel; a success clears them."""

    def step(state: tuple, t: int, _: int, failed: bool) -> tuple:
        n, until = state
        if t < until:
            return state, True
        n = n + 1 if failed else 0
        return ((0, t + cooldown) if n >= strikes else (n, until)), False

    return fold(calls, "user_id", ["t", "id"], ["failed"], lambda: (0, 0), step, "cooling boolean")


def quota_reset(reads: DataFrame, days: int = 30) -> DataFrame:
    """user_id, t, id, used for reads (user_id, t, id, pages): the count starts again where ``days`` have passed since it last did."""

    def step(state: tuple, t: int, _: int, pages: int) -> tuple:
        since, used = state
        if since is None or t - since > days * 86400:
            since, used = t, 0
        return (since, used + pages), used + pages

    return fold(reads, "user_id", ["t", "id"], ["pages"], lambda: (None, 0), step, "used long")


def keep_last_different(lines: DataFrame, percent: int = 45, min_chars: int = 6) -> DataFrame:
    """doc_id, k, dropped for lines (doc_id, k, c stripped text): a line goes where its bigrams are like those of the last one kept."""

    def step(state: tuple, _: int, c: str) -> tuple:
        own = frozenset(c[i : i + 2] for i in range(len(c) - 1)) if len(c) >= min_chars else None
        if own and state[0]:
            shared = len(own & state[0])
            # 100 x shared >= percent x all; short lines are like nothing
            if 100 * shared >= percent * (len(own) + len(state[0]) - shared):
                return state, True
        return (own,), False

    return fold(lines, "doc_id", ["k"], ["c"], lambda: (None,), step, "dropped boolean")
