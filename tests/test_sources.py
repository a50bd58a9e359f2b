"""Word documents, blobs and caches on small inputs."""

import io
import zipfile

from pyspark.sql import functions as F

from quire.sources import blobs, docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_read_docx(spark, tmp_path):
    nested = f"<w:tbl><w:tr><w:tc>{paragraph('inner')}</w:tc></w:tr></w:tbl>"
    body = paragraph("Introduction", "Heading1") + paragraph("12345") + f"<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph('b')}{nested}</w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{paragraph('Header Title')}</w:hdr>")
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    rows = [tuple(r)[1:] for r in docx.read_docx(spark, f"file://{tmp_path}").orderBy("part", "i").collect()]
    assert rows == [("body", 0, 0, "Heading1", "Introduction"), ("body", 1, 0, None, "12345"), ("body", 2, 1, None, "a"), ("body", 3, 1, None, "b"), ("body", 4, 2, None, "inner"), ("header", 0, 0, None, "Header Title")]


def test_chunks(spark):
    data = [("a", "in", bytearray(range(256)) * 3), ("b", "in", bytearray(b"")), ("c", "in", bytearray(b"xyz"))]
    df = spark.createDataFrame(data, "id string, kind string, data binary")
    chunks = blobs.to_chunks(df, 100)
    assert {r.id: bytes(r.data) for r in blobs.from_chunks(chunks).collect()} == {i: bytes(d) for i, _, d in data}
    assert {r.id for r in blobs.to_chunks(df, 100, 50).collect()} == {"b", "c"}
    gap = chunks.where("NOT (id = 'a' AND idx = 3)")
    assert {r.id: r.n for r in blobs.contiguous(gap).collect()} == {"a": 3, "b": 1, "c": 1}


def test_key_value(spark):
    table = spark.createDataFrame([("job/1", "x", 10), ("job/2", "y", 50), ("log/1", "z", 50)], "key string, value string, version long")
    after = blobs.put(table, spark.createDataFrame([("job/1", "new", 60), ("job/2", "old", 40)], "key string, value string, version long"))
    assert [tuple(r) for r in blobs.scan(after, "job/", F.lit(100), 45).orderBy("key").collect()] == [("job/1", "new", 60)]
    assert blobs.scan(after, "", F.lit(100), 1000, 2).count() == 2


def test_page_cache(spark, tmp_path):
    pages = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["c"]), ("m", 1, ["d"])], "cache_key string, page int, texts array<string>")
    done = pages.where("page = 1").withColumn("translations", F.transform("texts", F.upper))
    blobs.write_cache(done, f"{tmp_path}/cache")
    blobs.write_cache(done.where("cache_key = 'm'").withColumn("texts", F.array(F.lit("other"))), f"{tmp_path}/cache")
    hits, misses = blobs.cached_pages(pages, spark.read.parquet(f"{tmp_path}/cache"))
    assert [(r.cache_key, r.page, r.translations) for r in hits.collect()] == [("k", 1, ["A", "B"])]
    assert sorted((r.cache_key, r.page) for r in misses.collect()) == [("k", 2), ("m", 1)]
