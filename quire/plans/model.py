"""The model boundary: whole batches cross into Python once, through an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import folds
from quire.plans.dialect import Catalog, Spark, run_sql
from quire.plans.state import walk

catalog = Catalog()


class ModelError(RuntimeError):
    """What a client raises where it gets no usable answer; any other error is one of the program and is let through."""


def fake_client(texts: list[str]) -> list[str]:
    """Offline stand-in for a model: each letter becomes a Chinese character."""
    return ["".join(chr(0x4E00 + ord(c) % 2000) if c.isalpha() else c for c in t) for t in texts]


def fake_refiner(sources: list[str], drafts: list[str]) -> list[str]:
    """Offline stand-in for a second model: a full stop behind each draft; a batch with a source of a length divisible by 19 gets no answer."""
    if any(len(s) % 19 == 0 for s in sources):
        raise ModelError("no answer")
    return [d + "。" for d in drafts]


def translate(batches: DataFrame, client: Callable[[list[str]], list[str]] = fake_client) -> DataFrame:
    """``batches`` (doc_id, batch, texts) with ``values``, as many as the texts, in their order, and ``failed``; a batch that fails keeps its source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, failed = [], []
            for texts in map(list, frame["texts"]):
                try:
                    values = client(texts)
                except ModelError:
                    values = []
                failed.append(len(values) != len(texts))
                out.append(texts if failed[-1] else values)
            yield frame.assign(values=out, failed=failed)

    return batches.mapInPandas(run, "doc_id long, batch long, texts array<string>, values array<string>, failed boolean")


def refine(drafts: DataFrame, client: Callable[[list[str], list[str]], list[str]] = fake_refiner) -> DataFrame:
    """``drafts`` (doc_id, batch, texts, values) with ``refined`` and ``status``: ok, or failed where a batch keeps its drafts; only what was translated is refined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, status = [], []
            for texts, values in zip(map(list, frame["texts"]), map(list, frame["values"]), strict=True):
                todo = [i for i, (s, d) in enumerate(zip(texts, values, strict=True)) if d and d != s]
                try:
                    better = client([texts[i] for i in todo], [values[i] for i in todo]) if todo else []
                except ModelError:
                    better = []
                status.append("ok" if len(better) == len(todo) else "failed")
                if status[-1] == "ok":
                    for i, v in zip(todo, better, strict=True):
                        values[i] = v
                out.append(values)
            yield frame.drop(columns=["failed"], errors="ignore").assign(refined=out, status=status)

    return drafts.select("doc_id", "batch", "texts", "values").mapInPandas(run, "doc_id long, batch long, texts array<string>, values array<string>, refined array<string>, status string")


def _batches(spark, sf_dir: str) -> DataFrame:
    lines = run_sql(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, line FROM {Spark().lines()} l WHERE line <> ''")(spark, sf_dir)
    sized = lines.select("doc_id", F.col("k").cast("long").alias("k"), F.length("line").cast("long").alias("n"), "line")
    numbered = folds.greedy_batches(sized, 60, 6000).join(sized, ["doc_id", "k"])
    return numbered.groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line).alias("texts"))


def model_translate(spark, sf_dir: str) -> DataFrame:
    done = translate(_batches(spark, sf_dir))
    return done.select("doc_id", "batch", F.size("texts").alias("n_texts"), F.size("values").alias("n_values"), F.sha2(F.array_join("values", "\n"), 256).alias("digest"))


def model_refine(spark, sf_dir: str) -> DataFrame:
    done = refine(translate(_batches(spark, sf_dir)))
    return done.select("doc_id", "batch", "status", F.sha2(F.array_join("refined", "\n"), 256).alias("digest"))


_UNITS = lambda d: f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, line, length(line) AS n FROM {d.lines()} l WHERE line <> '')"
_FULL = "(s.c + 1 > 60 OR s.chars + x.n > 6000)"
_DEALT = lambda d: walk(d, _UNITS(d), "doc_id", "k", {"batch": "0", "c": "1", "chars": "x.n"}, {"batch": f"s.batch + CASE WHEN {_FULL} THEN 1 ELSE 0 END", "c": f"CASE WHEN {_FULL} THEN 1 ELSE s.c + 1 END", "chars": f"CASE WHEN {_FULL} THEN x.n ELSE s.chars + x.n END"}, "doc_id, k, line, =batch")
_FAKE = "list_aggregate(list_transform(string_split(line, ''), lambda c: CASE WHEN regexp_matches(c, '\\p{L}') THEN chr(19968 + unicode(c) % 2000) ELSE c END), 'string_agg', '')"
catalog.add("model_translate", model_translate, lambda d: f"SELECT doc_id, batch, CAST(count(*) AS INTEGER) AS n_texts, CAST(count(*) AS INTEGER) AS n_values, sha256(string_agg({_FAKE}, chr(10) ORDER BY k)) AS digest FROM ({_DEALT(d)}) w GROUP BY doc_id, batch")
catalog.add(
    "model_refine",
    model_refine,
    lambda d: f"SELECT doc_id, batch, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status, sha256(CASE WHEN bad THEN drafts ELSE finals END) AS digest FROM (SELECT doc_id, batch, coalesce(bool_or(length(line) % 19 = 0) FILTER (v <> line), false) AS bad, string_agg(v, chr(10) ORDER BY k) AS drafts, string_agg(CASE WHEN v <> line THEN v || '。' ELSE v END, chr(10) ORDER BY k) AS finals FROM (SELECT *, {_FAKE} AS v FROM ({_DEALT(d)}) w) x GROUP BY doc_id, batch) y",
)
