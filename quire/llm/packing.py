"""Packing along a space-filling curve.

A document's token counts, hashed to ``HASHED`` buckets, are projected by fixed
random signs to ``DIMS`` dimensions; the direction, on a grid of ``BITS`` bits an
axis, has a Hilbert key. Documents are range-partitioned and sorted by (key, doc_id),
so ties, such as large groups of copies, are split by doc_id, and each partition
lays its documents end to end into sequences of ``SEQUENCE`` tokens. What is left at
a partition's end is cut into sequences of falling powers of two, which need no
padding, so no position is padded at all.

Tokenised documents are written once to the shared folder, since range
partitioning reads its input twice. Ids are kept as two bytes each where the
vocabulary allows, else four.

Defined results: null text is empty and gives the end id alone. Null doc_ids and
repeated rows are packed as rows of their own. Empty tables give no pieces; extra
columns are ignored. Texts are tokenised whole, long ones too.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import scratch

SEQUENCE, END_ID = 4096, 2
HASHED, DIMS, BITS = 4096, 4, 15
#: Bounds of a worker's cache of words: its bytes, the characters of a word, and what an entry takes beside its characters.
CACHE_BYTES, CACHE_WORD, ENTRY_BYTES = 96 << 20, 48, 140
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Words(dict):
    """Ids by word in two generations, together bounded by ``CACHE_BYTES``; the frequent words outlive a generation.

    A word of over ``CACHE_WORD`` characters is never kept, so a text without spaces leaves nothing behind.
    """

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.old, self.bytes = encode, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHE_WORD:
            self[word] = ids
            self.bytes += ENTRY_BYTES + 2 * len(word) + len(ids)
        return ids

    def turn(self) -> None:
        """Start a new generation where this one is full; between texts, so it may exceed its half by one text's words."""
        if self.bytes > CACHE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.bytes = 0


class WordTokenizer:
    """Ids of whole texts through a cache of space-separated words, whose ids don't depend on their neighbours.

    Words of letters alone go to the vocabulary's model at once; any other word takes
    the tokenizer's whole path. Lower-casing, which the tokenizer does anyway, comes
    first where it commutes with its normal form.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.lower = self.direct("Straße") == self.whole("Straße") == self.whole("straße")
        self.marks = {m: self.whole(m) for m in ".,"}
        self.folded, self.raw = _Words(self.spelt), _Words(self.whole)

    def whole(self, word: str) -> bytes:
        """Ids by the tokenizer's whole path."""
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def direct(self, word: str) -> bytes:
        """Ids of a word of letters alone, lower-cased and in its normal form."""
        spelt = word.lower()
        if not spelt.isascii():
            spelt = spelt.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def spelt(self, word: str) -> bytes:
        """Ids of a word that is lower-cased and in its normal form already."""
        if word.isalpha():
            return self.direct(word)
        if word[-1:] in self.marks and (base := word[:-1]).isalpha():
            return self.direct(base) + self.marks[word[-1]]
        return self.whole(word)

    def encode(self, text: str) -> bytes:
        words = self.raw
        if self.lower and "\u03a3" not in text:
            low = text.lower()
            if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                text, words = low, self.folded
        words.turn()
        return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(2)
def _projection(ids: int) -> np.ndarray:
    """What each token id adds to a document's projected vector: its bucket's row of the projection."""
    buckets = (np.arange(ids, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - (HASHED.bit_length() - 1))
    return np.random.default_rng(3).standard_normal((HASHED, DIMS)).astype(np.float32)[buckets]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (unsigned, below 2**bits), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)


def document_keys(ids: list[np.ndarray], vocabulary: int = 1 << 16) -> np.ndarray:
    """Hilbert key of each document's projected direction; ids are below ``vocabulary``."""
    projection, sums = _projection(vocabulary), np.zeros((len(ids), DIMS))
    for k, x in enumerate(ids):
        for i in range(0, len(x), 1 << 16):
            sums[k] += projection[x[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    return hilbert_keys(np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64), BITS)


def tokenized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (binary, with the end id) and key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        end = np.array([END_ID], t.kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [t.encode(x or "") + end for x in part.column(1).to_pylist()]
                keys = document_keys([np.frombuffer(x, t.kind) for x in ids], max(t.tokenizer.get_vocab_size(), END_ID + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(keys)], names=["doc_id", "ids", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, key long")


def powers(n: int) -> list[int]:
    """Falling powers of two that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, size: int = SEQUENCE) -> None:
        self.size, self.full, self.fill, self.tail = size, 0, 0, []

    def add(self, document: object, tokens: int) -> list[tuple]:
        """The pieces of the sequences that this document completes; what lies in the open one is held back."""
        out, start = [], 0
        while start < tokens:
            length = min(tokens - start, self.size - self.fill)
            self.tail.append((document, start, length, self.full, self.fill))
            self.fill += length
            start += length
            if self.fill == self.size:
                out += self.tail
                self.tail, self.fill, self.full = [], 0, self.full + 1
        return out

    def close(self) -> list[tuple]:
        """The open sequence, cut into sequences of falling powers of two."""
        out, held = [], [(d, s, n) for d, s, n, _, _ in self.tail][::-1]
        for room in powers(self.fill):
            at = 0
            while at < room:
                d, s, n = held.pop()
                length = min(n, room - at)
                out.append((d, s, length, self.full, at))
                if n > length:
                    held.append((d, s + length, n - length))
                at += length
            self.full += 1
        self.tail, self.fill = [], 0
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str = TOKENIZER, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents; ``with_ids`` adds each piece's ids as an array of integers."""
    with scratch.text_batches(docs.sparkSession):
        ready = scratch.materialize(tokenized(docs, path), "tokens")
    ordered = ready.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, packer, part = _tokenizer(path).kind, Packer(sequence), TaskContext.get().partitionId()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for (doc_id, ids), start, length, number, offset in pieces:
                own = ids[start : start + length].astype("<u4")
                for column, v in zip(out, (doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), part << 40 | number, offset, own if with_ids else None), strict=True):
                    column.append(v)
            columns = [pa.array(c, pa.int64()) for c in out[:7]]
            return pa.RecordBatch.from_arrays(columns + [pa.array(out[7], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                done = []
                for doc_id, ids in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    x = np.frombuffer(ids, kind)
                    done += packer.add((doc_id, x), len(x))
                if done:
                    yield rows(done)
        if last := packer.close():
            yield rows(last)

    return ordered.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False)
