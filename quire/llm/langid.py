"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are not letters becomes one
boundary, and n-grams of 1 to 3 characters are hashed to ``BUCKETS`` features.
Training counts features per language on the executors; the driver turns the
counts (languages x buckets, bounded by the two parameters below) into a
log-probability matrix, which is broadcast. Scoring works on the sparse batch:
feature indices and row offsets of many texts at once, in numpy.

Defined results: a text that is null or has no letter gets ``und`` with score 0.
Empty training data: every text with a letter gets ``und`` too. Ties go to the
language that sorts first. Repeated rows are scored independently; rows whose
language is null train nothing; extra columns are ignored. Whole texts are
scored, in slices of ``SLICE`` characters whose sums are added; a slice looks back
over its border, so that a text's features don't depend on where it is cut. The
pipeline's stage keeps every document where no document is labelled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Documented bound of the training sample: about so many documents of each language.
TRAIN_DOCS_PER_LANG = 1500
#: Size bound of the broadcast matrix: languages x BUCKETS x 4 bytes.
MAX_MATRIX_MB = 256
SLICE = 1 << 18
UNDETERMINED = "und"


@functools.cache
def _fold_table() -> np.ndarray:
    """Code point to its lower-case code point if it is a letter, to a space otherwise."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _fold(text: str) -> np.ndarray:
    """Folded code points with single boundaries, one at each end; empty where the text has no letter."""
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    codes = codes[keep]
    if not (codes != 32).any():
        return codes[:0]
    parts = [codes]
    if codes[0] != 32:
        parts.insert(0, np.array([32], np.uint32))
    if codes[-1] != 32:
        parts.append(np.array([32], np.uint32))
    return np.concatenate(parts)


def _features(codes: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram, of orders 1 to 3, that ends in each position: shape (3, len(codes)); those that would begin before the text count as their shorter ones."""
    a = codes * np.uint32(2654435761)
    b, c = a.copy(), a.copy()
    b[1:] += codes[:-1] * np.uint32(2246822519)
    c[1:] = b[1:]
    c[2:] += codes[:-2] * np.uint32(3266489917)
    out = np.stack([a, b ^ np.uint32(0x9E3779B9), c ^ np.uint32(0x85EBCA6B)])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)


def _slices(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The features of a text, a slice of positions at a time."""
    for i in range(0, len(codes), SLICE):
        back = min(i, 2)
        yield _features(codes[i - back : i + SLICE])[:, back:].ravel()


def _texts(column: pa.ChunkedArray | pa.Array, rows: int = 256) -> Iterator[list]:
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        at = 0
        for texts in _texts(batch.column("text")):
            for text in texts:
                lang = langs[at]
                at += 1
                if not text:
                    continue
                for features in _slices(_fold(text)):
                    counts = np.bincount(features, minlength=BUCKETS)
                    sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [counts.astype("<i8").tobytes()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (buckets x languages, float32) and log-priors from (doc_id, text, lang).

    The sample of a language is chosen by a hash of doc_id below a threshold that
    gives about ``docs_per_lang`` documents, so it is the same on every run.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if len(langs) * BUCKETS * 4 > MAX_MATRIX_MB << 20:
        raise ValueError(f"{len(langs)} languages exceed the matrix bound of {MAX_MATRIX_MB} MB")
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        uniform = (F.xxhash64(F.lit("langid"), F.col("doc_id")) % 1_000_000).cast("double") / 2e6 + 0.5
        rate = F.coalesce(*[F.when(F.col("lang") == g, F.lit(min(1.0, docs_per_lang / sizes[g]))) for g in langs])
        sample = labelled.where(uniform <= rate).select("lang", "text")
        where = {g: i for i, g in enumerate(langs)}
        for row in sample.mapInArrow(_count, "lang string, counts binary").toLocalIterator():
            counts[where[row.lang]] += np.frombuffer(row.counts, "<i8")
    smoothed = counts + 0.5
    logp = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)) if langs else smoothed
    total = sum(sizes.values())
    prior = np.log([sizes[g] / total for g in langs]) if langs else np.zeros(0)
    return langs, np.ascontiguousarray(logp.T, np.float32), prior


def _score_block(blocks: list[tuple[int, np.ndarray]], logp: np.ndarray, sums: np.ndarray) -> None:
    """Add the log-probabilities of one sparse block (row, features) to the rows' sums."""
    offsets = np.cumsum([0, *[len(f) for _, f in blocks[:-1]]])
    gathered = logp[np.concatenate([f for _, f in blocks])]
    np.add.at(sums, [row for row, _ in blocks], np.add.reduceat(gathered, offsets, axis=0, dtype=np.float64))


def predict(column: pa.Array | pa.ChunkedArray, model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    langs, logp, prior = model
    n = len(column)
    if not langs:
        return [UNDETERMINED] * n, np.zeros(n)
    sums, seen, at, held, size = np.zeros((n, len(langs))), np.zeros(n, bool), 0, [], 0
    for texts in _texts(column):
        for text in texts:
            for features in _slices(_fold(text)) if text else ():
                seen[at] = True
                held.append((at, features))
                size += len(features)
                if size >= SLICE:
                    _score_block(held, logp, sums)
                    held, size = [], 0
            at += 1
    if held:
        _score_block(held, logp, sums)
    sums += prior
    # the posterior, tempered by the n-grams' overlap: each character counts in three of them
    p = np.exp((sums - sums.max(axis=1, keepdims=True)) / 3)
    pred = [langs[i] if s else UNDETERMINED for i, s in zip(sums.argmax(axis=1), seen, strict=True)]
    return pred, np.where(seen, 1 / p.sum(axis=1), 0.0)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` but lang, source and n_chars are left out: doc_id, text -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold_of(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(fold_of("doc_id") != 2))
    return classify(docs, model).select("doc_id", (fold_of("doc_id") == 2).alias("held_out"), "lang_pred", "score")


#: Documents whose prediction is less sure than this are rejected by the pipeline's stage, besides those without letters.
MIN_SCORE = 0.4


def stage_language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; ``lang`` stays as given, or is filled with the prediction where null.

    Without any labelled document nothing can be told, and every document stays.
    """
    model = train(docs.where(fold_of("doc_id") != 2))
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):  # else a worker and the JVM hold all the texts of a batch once more on their way back
                batch = whole.slice(i, 512)
                pred, score = predict(batch.column("text"), shared.value)
                ok = np.array([p != UNDETERMINED for p in pred], bool) & (score >= MIN_SCORE) if shared.value[0] else np.ones(batch.num_rows, bool)
                given = batch.column("lang").to_pylist()
                out = [pa.array([g if g is not None else p for g, p in zip(given, pred, strict=True)], pa.string()) if c == "lang" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
