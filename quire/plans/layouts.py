"""Queries of the operators over a page, a unit or a reply: recognised words, replies over lines, wrapping. No SQL can say them; tests hold them to given cases and plain properties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

from quire.functions import text as T
from quire.operators import layout
from quire.plans.dialect import Catalog, Spark, run_sql
from quire.plans.geometry import BOXES

catalog = Catalog()
_D = Spark()


def _sent(text: str) -> bool:
    return any(c.isascii() and c.isalpha() for c in text) and not any("一" <= c <= "鿿" for c in text)


def ocr_line_grouping(spark, sf_dir: str):
    """The lines of each page of words, which are boxes of line items in the place of recognised ones."""
    words = run_sql(f"SELECT page, i, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CASE WHEN i % 5 = 0 THEN '12' ELSE concat('word', i) END AS word FROM {BOXES} b")(spark, sf_dir)

    def lines(rows: list[dict]) -> list[dict]:
        found = layout.ocr_lines([(r["x0"], r["y0"], r["x1"], r["y1"], r["word"]) for r in rows])
        units = layout.page_units([(r["x0"], r["y0"], r["x1"], r["y1"], r["word"]) for r in rows], _sent)
        return [{"page": rows[0]["page"], "n_lines": len(found), "n_units": len(units), "text": " | ".join(x["text"] for x in found), "units": " | ".join(units)}]

    schema = pa.schema([("page", pa.int64()), ("n_lines", pa.int64()), ("n_units", pa.int64()), ("text", pa.string()), ("units", pa.string())])
    return layout.per_key(words, "page", ["i"], lines, schema, "page long, n_lines long, n_units long, text string, units string")


def _rows(table, apply, schema: pa.Schema, ddl: str):
    """What ``apply`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_pylist([apply(row) for row in batch.slice(i, 1024).to_pylist()], schema=schema)

    return table.mapInArrow(run, ddl)


def allocate_split(spark, sf_dir: str):
    """A document's text in place of a reply, split over its lines by their lengths."""
    units = run_sql(f"SELECT doc_id, {_D.join('line', ' ', 'i')} AS reply, transform(array_sort(collect_list(struct(i, length(line) + 1 AS w))), e -> CAST(e.w AS DOUBLE)) AS widths FROM (SELECT doc_id, i, {T.strip(_D, 'line')} AS line FROM {_D.lines()} l) s GROUP BY doc_id")(spark, sf_dir)

    def split(row: dict) -> dict:
        parts = layout.split_reply(row["reply"], row["widths"])
        return {"doc_id": row["doc_id"], "n_lines": len(row["widths"]), "covered_only": sum(not p for p in parts), "digest": hashlib.sha256("\n".join(parts).encode()).hexdigest()}

    return _rows(units, split, pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("covered_only", pa.int64()), ("digest", pa.string())]), "doc_id long, n_lines long, covered_only long, digest string")


def wrap_and_fit(spark, sf_dir: str):
    """Turns wrapped to a column of 200 points at size 10, and the largest size that fits 60 points of height."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")

    def apply(row: dict) -> dict:
        text = row["text"] or ""
        lines = layout.wrap(text, 10.0, 200.0)
        return {"conv_id": row["conv_id"], "turn": row["turn"], "n_lines": len(lines), "widest": max(layout.text_width(x, 10.0) for x in lines), "size": layout.fit(text, 200.0, 60.0, 12.0)}

    return _rows(turns, apply, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("n_lines", pa.int64()), ("widest", pa.float64()), ("size", pa.float64())]), "conv_id long, turn long, n_lines long, widest double, size double")


catalog.add("ocr_line_grouping", ocr_line_grouping)
catalog.add("allocate_split", allocate_split)
catalog.add("wrap_and_fit", wrap_and_fit)
