"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are dealt, in table order, into blocks of about ``BLOCK_CHARS`` characters, each
a row with the block's distinct words (matches of the pattern) and every document as
indices into them. Words are cut where no merge can cross (``cut`` says why), and Spark
folds the ranked merges over the byte arrays of the block's distinct parts; a word's ids
are those of its parts in turn. A piece is one long: the rank of the pair that it begins, its place, its id; so
the least element of the array is the leftmost pair of the lowest rank, and a merge
looks up the two new pairs only. The literal rank map goes from pairs of ids to ranks;
it is laid out as a literal array of sparse rows, since Spark scans the keys of a map. Nothing is shuffled, and no vocabulary of the corpus is gathered.

A step of the fold costs the part's length, so a fold costs its square; parts of over
``FOLD_BYTES`` bytes, such as long runs of one symbol, are merged with a heap while
the blocks are made, to the same ids.

Defined results: null text is empty and gives no ids. Null doc_ids and repeated rows
are encoded as rows of their own. Empty tables give no rows; extra columns are
ignored. Ids that are not in the ranks, or null, raise an error in ``decode``; bytes
that the ranks lack raise one in ``encode``.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS, FOLD_BYTES = 24_000_000, 64
#: An element of the fold has the rank in the bits from 32 on, the place from 20 on, the id below.
PLACE_BIT, RANK_BIT, NO_RANK = 20, 32, (1 << 31) - 1
ID_MASK, LOW_MASK = (1 << PLACE_BIT) - 1, (1 << RANK_BIT) - 1
#: What stands in a free place of the pair table: above every (id, rank).
FREE = 1 << 62
#: Bytes of words that are cut at a time, passes of early merges, and bits of a place in the hashed tables of ranks and of crossings, which every worker holds.
CUT_BYTES, CUT_PASSES, RANK_PLACES, CROSS_PLACES = 1 << 17, 3, 17, 23
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pairs(path: str) -> list[tuple[bytes, bytes, int]]:
    """Left and right piece and rank of every pair that merges."""
    ranks = load_ranks(path)
    return [(p[:i], p[i:], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]


@functools.lru_cache(2)
def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The pair table and where each left id's row begins in it.

    The rank of (a, b) stands at starts[a] + b, as (a, rank) in the high and low 32 bits:
    sparse rows laid over each other where they have no place in common, longest first.
    """
    ranks = load_ranks(path)
    if max(ranks.values(), default=0) > ID_MASK:
        raise ValueError(f"ranks above {ID_MASK}")
    rows: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in _pairs(path):
        rows.setdefault(ranks[a], []).append((ranks[b], r))
    ids, step = max(ranks.values(), default=-1) + 1, 2048
    table, starts = np.full(ids, FREE, np.int64), np.zeros(ids, np.int64)
    hints: dict[int, int] = {}  # where the last row of about this length found its place
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        b, r = np.array(row, np.int64).T
        begin, low = hints.get(len(b).bit_length(), 0), int(b.min())
        while True:
            if begin + step + ids > len(table):
                table = np.concatenate([table, np.full(len(table) + step, FREE, np.int64)])
            # places that the row's least id may take, of the next few
            at = np.nonzero(table[begin + low : begin + low + step] == FREE)[0] + begin
            fits = np.nonzero((table[at[:, None] + b] == FREE).all(axis=1))[0] if len(at) else at
            if len(fits):
                break
            begin += step
        hints[len(b).bit_length()] = begin
        starts[a] = at[fits[0]]
        table[starts[a] + b] = a << RANK_BIT | r
    used = np.nonzero(table != FREE)[0]
    return table[: used[-1] + 1 if len(used) else 0], starts


@functools.lru_cache(2)
def _byte_pairs(path: str) -> str:
    """JSON of the elements, but for their places, that a byte x begins before a byte y at x * 257 + y, and before the end at y = 256; null where the ranks lack x."""
    ranks, end = load_ranks(path), [b""]
    ids = [ranks.get(bytes([x])) for x in range(256)]
    return json.dumps([None if ids[x] is None else ranks.get(bytes([x]) + y if y else y, NO_RANK) << RANK_BIT | ids[x] for x in range(256) for y in [*(bytes([b]) for b in range(256)), *end]])


def _place(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs of ids in a hashed table."""
    mixed = (a.astype(np.uint64) << np.uint64(PLACE_BIT) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Joints(NamedTuple):
    """What ``cut`` has to know of the ranks, by id; one id more stands for a byte that the ranks lack. Where pairs share a place of a hashed table, the least rank and any crossing hold for all, so that a cut may be missed but none is made wrongly."""

    byte_ids: np.ndarray
    first: np.ndarray  # first byte of a piece
    last: np.ndarray
    table: np.ndarray  # as of _pair_table
    starts: np.ndarray
    early: np.ndarray  # whether a piece is in no pair of a lower rank than its own
    before: np.ndarray  # hashed by (byte, id): the least rank of a pair of a piece with that last byte and that id
    after: np.ndarray  # hashed by (id, byte): the least rank of a pair of that id and a piece with that first byte
    across: np.ndarray  # bits hashed by (id, id): whether some pair's left piece ends in the one and its right piece begins with the other

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.table[self.starts[a] + b]
        return np.where(found >> RANK_BIT == a, found & LOW_MASK, NO_RANK)

    def least_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.before[_place(self.last[a], b, RANK_PLACES)]

    def least_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.after[_place(a, self.first[b], RANK_PLACES)]

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = _place(a, b, CROSS_PLACES)
        return (self.across[at >> 3] >> (at & 7) & 1).astype(bool)


@functools.lru_cache(2)
def _joints(path: str) -> Joints:
    ranks, (table, starts), pairs = load_ranks(path), _pair_table(path), _pairs(path)
    none = len(starts)
    first, last, early = np.zeros(none + 1, np.int64), np.zeros(none + 1, np.int64), np.ones(none + 1, bool)
    for p, r in ranks.items():
        first[r], last[r] = p[0], p[-1]
    a, b, r = (np.array(x, np.int64) for x in zip(*[(ranks[x], ranks[y], z) for x, y, z in pairs], strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
    for x in (a, b):
        early[x[r <= x]] = False
    early[none] = False
    before, after, across = np.full(1 << RANK_PLACES, NO_RANK, np.int32), np.full(1 << RANK_PLACES, NO_RANK, np.int32), np.zeros(1 << CROSS_PLACES, bool)
    np.minimum.at(before, _place(last[a], b, RANK_PLACES), r.astype(np.int32))
    np.minimum.at(after, _place(a, first[b], RANK_PLACES), r.astype(np.int32))
    tails = {p: [ranks[p[i:]] for i in range(len(p)) if p[i:] in ranks] for p in {x for x, _, _ in pairs}}
    heads = {p: [ranks[p[:i]] for i in range(1, len(p) + 1) if p[:i] in ranks] for p in {y for _, y, _ in pairs}}
    crossing = {(x, y) for p, q, _ in pairs for x in tails[p] for y in heads[q]}
    x, y = (np.fromiter((c[k] for c in crossing), np.int64, len(crossing)) for k in (0, 1))
    across[_place(x, y, CROSS_PLACES)] = True
    byte_ids = np.array([ranks.get(bytes([x]), none) for x in range(256)], np.int64)
    return Joints(byte_ids, first, last, np.append(table, np.full(none + 1, FREE)), np.append(starts, 0), early, before, after, np.packbits(across, bitorder="little"))


def cut(text: bytes, begins: np.ndarray, joints: Joints) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts begin that words, which begin at ``begins`` of ``text``, can be cut into, and which of these begin a word: the ids of a word are those of its parts in turn.

    A pair merges early if every pair that could take one of its pieces first, whatever
    its neighbours have grown to by then, has a higher rank, and if no pair that its piece
    is in has a lower one: before its turn nothing touches it, and nothing that it makes
    comes before its turn, so the ids are the same as if it were merged at once. Between two pieces of such
    merges lies a cut if no pair's left piece ends in the left one while its right piece
    begins with the right one: then no merge ever crosses, and either side goes its own
    way. Early merges serve to find the cuts alone; parts are folded from their bytes.
    """
    ids = joints.byte_ids[np.frombuffer(text, np.uint8)]
    at, heads = np.arange(len(ids)), np.zeros(len(ids), bool)
    heads[begins] = True
    for _ in range(CUT_PASSES):
        if len(ids) < 2:
            break
        a, b, inside = ids[:-1], ids[1:], ~heads[1:]
        rank = np.where(inside, joints.rank(a, b), NO_RANK)
        before = np.where(inside, joints.least_before(a, b), NO_RANK)
        after = np.where(inside, joints.least_after(a, b), NO_RANK)
        merge = (rank < np.append(NO_RANK, before[:-1])) & (rank < np.append(after[1:], NO_RANK)) & joints.early[np.minimum(rank, len(joints.early) - 1)]
        ids = np.append(np.where(merge, rank, a), ids[-1])
        keep = np.append(True, ~merge)
        ids, at, heads = ids[keep], at[keep], heads[keep]
    parts = heads.copy()
    parts[1:] |= ~joints.crossed(ids[:-1], ids[1:])
    return at[parts], heads[parts]


@functools.lru_cache(2)
def _pieces(path: str) -> str:
    """JSON of the pieces by id; a byte is written as the character of its number."""
    ranks = load_ranks(path)
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return json.dumps(pieces)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of pairs: the same merges as the fold, in n log n steps."""
    n = len(word)
    parts, left, right = [word[i : i + 1] for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], right[i] = pair, None, right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and (b := right[a]) < n and (p := parts[a] + parts[b]) in ranks:
                heapq.heappush(heap, (ranks[p], a, p))
    return [ranks[p] for p in parts if p is not None]


#: The pattern of public_tokenizers.PATTERN for texts of Latin-1 alone, by classes that the faster standard module knows.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@functools.lru_cache(2)
def _splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    latin = re.compile(LATIN_PATTERN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return latin(text)

    return split


def blocks(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """parts (byte array, or ids of a long one), words (indices into parts) and docs (doc_id, indices into words) of each block of documents."""
    part_type = pa.struct([("bytes", pa.list_(pa.int16())), ("ids", pa.list_(pa.int32()))])
    doc_type = pa.struct([("doc_id", pa.int64()), ("words", pa.list_(pa.int32()))])
    schema = pa.schema([("parts", pa.list_(part_type)), ("words", pa.list_(pa.list_(pa.int32()))), ("docs", pa.list_(doc_type))])
    joints = _joints(path)

    def numbers() -> defaultdict:
        table = defaultdict()
        table.default_factory = table.__len__
        return table

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    def cut_words(words: Iterable[str]) -> tuple[dict[bytes, int], pa.ListArray]:
        """Numbers of the distinct parts, and the numbers of every word's parts."""
        parts, indices, firsts, some, n, size = numbers(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0, 0

        def cut_some() -> int:
            text = b"".join(some)
            begins, heads = cut(text, np.cumsum([0, *map(len, some[:-1])]), joints)
            bounds = [*begins.tolist(), len(text)]
            indices.append(np.fromiter((parts[text[x:y]] for x, y in itertools.pairwise(bounds)), np.int32, len(begins)))
            firsts.append(np.nonzero(heads)[0] + n)
            some.clear()
            return n + len(begins)

        for word in words:
            some.append(word.encode("utf-8", "surrogatepass"))
            size += len(some[-1])
            if size >= CUT_BYTES:
                n, size = cut_some(), 0
        if some:
            n = cut_some()
        return parts, lists(np.append(np.concatenate(firsts), n), np.concatenate(indices))

    def row(table: dict[str, int], doc_ids: list, indices: list[np.ndarray]) -> pa.RecordBatch:
        parts, words = cut_words(table)
        table.clear()
        ids = [merge_long(x, load_ranks(path)) if len(x) > FOLD_BYTES else None for x in parts]
        short = [x if len(x) <= FOLD_BYTES else b"" for x in parts]
        spelt = lists(np.cumsum([0, *map(len, short)]), np.frombuffer(b"".join(short), np.uint8).astype(np.int16))
        folded = pa.StructArray.from_arrays([spelt, pa.array(ids, pa.list_(pa.int32()))], fields=list(part_type))
        used = lists(np.cumsum([0, *map(len, indices)]), np.concatenate([*indices, np.zeros(0, np.int32)]))
        indices.clear()
        own = pa.StructArray.from_arrays([pa.array(doc_ids, pa.int64()), used], fields=list(doc_type))
        wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([wrap(folded), wrap(words), wrap(own)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(pattern)
        table, doc_ids, indices, size = numbers(), [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = split(text) if text else []
                    indices.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
                    doc_ids.append(doc_id)
                    size += len(text or "") + 1
                    if size >= BLOCK_CHARS:
                        yield row(table, doc_ids, indices)
                        table, doc_ids, indices, size = numbers(), [], [], 0
        if doc_ids:
            yield row(table, doc_ids, indices)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "parts array<struct<bytes: array<smallint>, ids: array<int>>>, words array<array<int>>, docs array<struct<doc_id: long, words: array<int>>>"
    )


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands, and is evaluated, once: the variable of a transform over one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_words(words: Column, path: str = RANKS) -> Column:
    """Ids of each of ``words``, whose bytes are an array unless their ids are there already. The rank map is one literal in the plan."""
    table, starts, byte_pairs = (F.from_json(F.lit(x), "array<bigint>") for x in (*(json.dumps(x.tolist()) for x in _pair_table(path)), _byte_pairs(path)))
    ids = lambda t, s, b: F.transform(words, lambda w: F.coalesce(w.ids, fold_merges(w["bytes"], t, s, b)))
    return _bind(table, lambda t: _bind(starts, lambda s: _bind(byte_pairs, lambda b: ids(t, s, b))))


def fold_merges(word: Column, table: Column, starts: Column, byte_pairs: Column) -> Column:
    """Ids of one word, an array of its bytes, by a pair table and what single bytes begin."""
    number = lambda x: F.lit(x).cast("long")
    missing = F.raise_error(F.lit("a byte that the ranks lack")).cast("long")

    def rank(a: Column, b: Column) -> Column:
        """Rank of a pair of ids, shifted to its bits; that of no pair where there is none or b is null."""
        found = F.get(table, (F.get(starts, a.cast("int")) + b).cast("int"))
        # another row's entry differs in the high bits, so it comes out above every rank; least() passes over null
        return F.shiftleft(F.least(found.bitwiseXOR(F.shiftleft(a, RANK_BIT)), number(NO_RANK)), RANK_BIT)

    def first(x: Column, i: Column) -> Column:
        found = F.get(byte_pairs, x.cast("int") * 257 + F.coalesce(F.get(word, i + 1).cast("int"), F.lit(256)))
        return F.coalesce(found, missing).bitwiseOR(F.shiftleft(i.cast("long"), PLACE_BIT))

    def step(acc: Column, _: Column) -> Column:
        place = lambda e: e.bitwiseAND(number(LOW_MASK ^ ID_MASK))
        own_id = lambda e: e.bitwiseAND(number(ID_MASK))

        def merged(least: Column, new_id: Column, second: Column) -> Column:
            new = rank(new_id, own_id(F.get(acc, second + 1))).bitwiseOR(place(least)).bitwiseOR(new_id)
            before = lambda left: left.bitwiseAND(number(LOW_MASK)).bitwiseOR(rank(own_id(left), new_id))
            # what follows the pair moves up by one place, so that places are indices throughout
            change = lambda e, i: F.when(i > second, e - number(1 << PLACE_BIT)).when(i < second - 2, e).when(i == second, number(-1)).when(i < second - 1, before(e)).otherwise(new)
            # slice and concat cost far more than a pass over so few elements, and a filter's function more than array_remove
            return F.array_remove(F.transform(acc, change), number(-1))

        second = lambda least: F.shiftright(place(least), PLACE_BIT).cast("int") + 1
        merge = lambda least: _bind(F.shiftright(least, RANK_BIT), lambda new_id: _bind(second(least), lambda k: merged(least, new_id, k)))  # noqa: E731  the id of a merged pair is its rank
        return _bind(F.array_min(acc), lambda least: F.when(least >= number(NO_RANK << RANK_BIT), acc).otherwise(merge(least)))

    start = F.transform(word, first)
    steps = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(F.aggregate(steps, start, step), lambda e: e.bitwiseAND(number(ID_MASK)).cast("int"))


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text)."""
    joined = lambda ids: F.transform("words", lambda w: F.flatten(F.transform(w, lambda i: F.get(ids, i))))
    encoded = blocks(docs, path, pattern).select("docs", _bind(fold_words(F.col("parts"), path), joined).alias("codes"))
    each = F.transform("docs", lambda d: F.struct(d.doc_id.alias("doc_id"), F.flatten(F.transform(d.words, lambda i: F.get("codes", i))).alias("ids")))
    return encoded.select(F.inline(each))


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the pieces of its ids, concatenated."""
    pieces = F.from_json(F.lit(_pieces(path)), "array<string>")
    missing = F.raise_error(F.lit("an id that the ranks lack")).cast("string")
    joined = _bind(pieces, lambda p: F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(p, i), missing)), ""))
    return encoded.withColumn("decoded", F.encode(joined, "ISO-8859-1"))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encoded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
