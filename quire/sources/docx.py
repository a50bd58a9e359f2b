"""Word documents as a table of paragraphs, in document order, with nested tables, headers and footers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_DEPTH = 6
SCHEMA = "doc string, part string, i int, depth int, style string, text string"
#: Elements whose paragraph is left as it is. Fixed values.
PROTECTED = frozenset("drawing pict object fldChar fldSimple instrText footnoteReference endnoteReference commentReference sym oMath oMathPara hyperlink sdt".split())


def _walk(node: ElementTree.Element, depth: int) -> Iterator[tuple[int, ElementTree.Element]]:
    """Paragraphs below a container with the depth of their table, tables down to MAX_DEPTH."""
    for child in node:
        if child.tag == f"{W}p":
            yield depth, child
        elif child.tag == f"{W}tbl":
            if depth < MAX_DEPTH:
                for cell in child.iter(f"{W}tc"):
                    if not any(cell in set(inner.iter(f"{W}tc")) for inner in child.iter(f"{W}tbl") if inner is not child):
                        yield from _walk(cell, depth + 1)
        elif child.tag in (f"{W}body", f"{W}sdt", f"{W}sdtContent"):
            yield from _walk(child, depth)


def paragraphs(data: bytes) -> Iterator[tuple[str, int, int, str | None, str]]:
    """part, place, depth, style and text of each paragraph; a header or footer part counts once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
        for name in ["word/document.xml", *names]:
            part = "body" if name == "word/document.xml" else "header" if "header" in name else "footer"
            root = ElementTree.fromstring(z.read(name))  # noqa: S314
            for i, (depth, p) in enumerate(_walk(root, 0)):
                style = p.find(f"{W}pPr/{W}pStyle")
                yield part, i, depth, None if style is None else style.get(f"{W}val"), "".join(t.text or "" for t in p.iter(f"{W}t"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of every .docx file below ``path``; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                rows = [(name.rpartition("/")[2], *p) for p in paragraphs(data)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "part", "i", "depth", "style", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
