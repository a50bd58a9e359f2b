"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped where an earlier line is equal to it, or is within one edit
(insertion, deletion or substitution of a character) of it; the earliest line stays.
"Earlier" goes by the first occurrence of each text, in order of doc_id and place.

1. Equal lines meet by a 128-bit hash; what is kept of a text is its first occurrence.
2. Within one edit, two texts agree in the first or the second half of the shorter
   one, counted from the start or the end. Texts that share no half with another
   have no neighbour and emit nothing further.
3. The others emit all variants within the bound, themselves and each deletion of one
   character in a half that is not shared, as hashed keys. A variant's hash is an exclusive-or of hashed
   (character, place), so a line of n characters costs n steps, not n squared.
4. Equal variants join: two deletions at one place are a substitution, a whole text
   and a deletion are an insertion. Groups are met through their earliest member,
   never as pairs, and are bounded by the alphabet, since texts are distinct.
5. ``levenshtein`` verifies each candidate.

Defined results: blank lines are always kept. Lines of fewer than ``min_chars``
characters are only dropped for equal ones. Null text stays null; a text whose lines
all go becomes empty; no row goes. Rows of null doc_id come last; equal rows are told
apart by their place in the table. An empty table stays empty. Other columns, whatever
their names, are passed on. A text's lines are rebuilt in one row, as it came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import scratch
from quire.llm.rows import steady

MIN_CHARS = 16
#: Most candidate texts whose places are broadcast, after they have been counted; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
CHUNK = 256


def _halves(line: Column) -> Column:
    """Keys of both halves, for the text as the one of equal length or the shorter one, and as the longer one."""

    def keys(n: Column) -> list[Column]:
        cut = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit("start"), n, F.substring(line, F.lit(1), cut)), F.xxhash64(F.lit("end"), n, F.right(line, n - cut))]

    n = F.length(line)
    return F.array(*keys(n), *keys(n - 1))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once: the variable of a transform over one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _variants(line: Column) -> Column:
    """array of (hash, place): the text itself at place -1, then each deletion of a character.

    With h(c, j) the hash of character c at place j, deletion i is the exclusive-or of
    h(c_j, j) over j < i and h(c_j, j - 1) over j > i.
    """
    return _bind(F.split(line, ""), _variants_of)


def _variants_of(chars: Column) -> Column:
    zero = F.lit(0).cast("long")
    h = lambda j: F.xxhash64(F.get(chars, j), j)
    moved = lambda j: F.xxhash64(F.get(chars, j), j - 1)
    xor = lambda a, b: a.bitwiseXOR(b)
    n = F.size(chars)
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda a, j: xor(a, h(j)))
    all_moved = F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda a, j: xor(a, moved(j)))
    # running sums in chunks, since an array that grows by one costs its length each time
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    none = F.expr("cast(array() as array<bigint>)")
    nested = F.expr("cast(named_struct('x', 0L, 'out', cast(array() as array<array<bigint>>)) as struct<x: bigint, out: array<array<bigint>>>)")

    def inner(x: Column, chunk: Column) -> Column:
        places = F.sequence(chunk * CHUNK, F.least((chunk + 1) * CHUNK, n) - 1)
        begin = F.struct(x.alias("x"), none.alias("out"))
        return F.aggregate(places, begin, lambda a, j: _bind(moved(j), lambda m: F.struct(xor(a.x, xor(h(j), m)).alias("x"), F.array_append(a.out, xor(a.x, m)).alias("out"))))

    def outer(a: Column, chunk: Column) -> Column:
        return _bind(inner(a.x, chunk), lambda b: F.struct(b.x.alias("x"), F.array_append(a.out, b.out).alias("out")))

    before = F.flatten(F.aggregate(chunks, nested, outer, lambda a: a.out))
    own = F.array(F.struct(whole.alias("hash"), F.lit(-1).alias("place")))
    return _bind(all_moved, lambda m: F.concat(own, F.transform(before, lambda x, i: F.struct(xor(x, m).alias("hash"), i.alias("place")))))


def _lines(rows: DataFrame) -> DataFrame:
    """first (place of the line, in order), line of every line that is not blank; rows has rid, doc_id, text."""
    out = rows.select("rid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).where(F.trim("line") != "")
    return out.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "place").alias("first"), "line")


def near_lines(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """id of the texts that are within one edit of an earlier one; ``texts`` has id, first, halves (null for short ones)."""
    keyed = texts.where("halves IS NOT NULL").select("id", F.posexplode("halves").alias("kind", "half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    # a shared start leaves the edit to the second half, a shared end to the first
    at_start = F.col("kind") % 2 == 0
    candidates = keyed.join(shared, "half", "left_semi").groupBy("id").agg(F.bool_or(at_start).alias("late"), F.bool_or(~at_start).alias("early"))
    found = scratch.materialize(candidates.join(texts, "id").select("id", "late", "early", F.col("first.rid").alias("rid"), F.col("first.place").alias("place")), "line-candidates")
    places = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    lines = _lines(rows).select(F.col("first.rid").alias("rid"), F.col("first.place").alias("place"), "first", "line")
    spelt = scratch.materialize(lines.join(places, ["rid", "place"]).select("id", "late", "early", "first", "line"), "line-texts")
    n = F.length("line")
    possible = lambda v: (v.place < 0) | (F.col("late") & (v.place >= F.floor((n - 1) / 2))) | (F.col("early") & (v.place <= F.floor(n / 2)))
    emitted = spelt.select("id", n.alias("n"), F.explode(F.filter(_variants(F.col("line")), possible)).alias("v"))
    emitted = emitted.select("id", (F.col("n") - (F.col("v.place") >= 0).cast("int")).alias("n"), "v.hash", "v.place")
    variants = scratch.materialize(emitted, "line-variants")
    whole, deleted = variants.where("place < 0").select("n", "hash", F.col("id").alias("whole")), variants.where("place >= 0")
    firsts = spelt.select("id", "first")
    # substitutions: those that leave the same rest at the same place, against the earliest of them
    same = ["n", "hash", "place"]
    shared = deleted.groupBy(*same).agg(F.count("*").alias("size")).where("size > 1").select(*same)
    members = deleted.join(shared, same, "left_semi").join(firsts, "id").select(*same, "first")
    swapped = members.join(members.groupBy(*same).agg(F.min("first").alias("other")), same).where("first > other").select("first", "other")
    # insertions: the whole text is on one side
    longer = deleted.join(whole, ["n", "hash"]).select("id", "whole").distinct()
    longer = longer.join(firsts, "id").join(firsts.select(F.col("id").alias("whole"), F.col("first").alias("other")), "whole")
    inserted = longer.select(F.greatest("first", "other").alias("first"), F.least("first", "other").alias("other"))
    pairs = swapped.unionByName(inserted).distinct()
    two = spelt.select(F.col("first").alias("other"), F.col("line").alias("other_line"))
    # levenshtein with a bound gives -1 beyond it
    verified = pairs.join(spelt, "first").join(two, "other").where(F.levenshtein("line", "other_line", 1) >= 0)
    near = scratch.materialize(verified.select("id").distinct(), "line-near")
    scratch.release(found, spelt, variants)
    return near


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A struct column ``row`` of all columns of ``docs``, and text, n_lines, dropped (places of the dropped lines).

    ``docs`` is read more than once; what is no plain scan of files is written first, so that row numbers stay.
    """
    docs = steady(docs)
    held = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    rows = held.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashes = (F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    hashed = _lines(rows).select(*hashes, "first", F.when(F.length("line") >= min_chars, _halves(F.col("line"))).alias("halves"))
    distinct = hashed.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.any_value("halves").alias("halves"))
    texts = scratch.materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "line-hashes")
    near = near_lines(rows, texts)
    place_of = lambda c: (F.col(f"{c}.rid").alias(f"{c}_rid"), F.col(f"{c}.place").alias(f"{c}_place"))
    verdicts = texts.select("h1", "h2", "id", *place_of("first")).join(near.withColumn("near", F.lit(True)), "id", "left").drop("id")
    places = _lines(rows).select(*hashes, F.col("first.rid").alias("rid"), F.col("first.place").alias("place")).join(verdicts, ["h1", "h2"])
    gone = (F.col("rid") != F.col("first_rid")) | (F.col("place") != F.col("first_place")) | F.col("near")
    dropped = places.where(gone).groupBy("rid").agg(F.collect_list("place").alias("dropped"))
    joined = held.join(dropped, "rid", "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    return joined.select(
        "row", F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n_lines"), F.coalesce(F.array_sort("dropped"), F.expr("cast(array() as array<int>)")).alias("dropped"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"), "text")


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their repeated lines taken out and n_chars brought up to date; every document stays."""
    found = dedup_lines(docs)
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


#: Earlier is by (doc_id, place). levenshtein() counts bytes there, at most four to a character, so what it lets by is compared
#: by characters: p is the length of the common start, and the rest must be equal after the edit.
OP6_SQL = """
WITH l AS (
  SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS place, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), f AS (
  SELECT line, length(line) AS n, min(doc_id * 1000000000 + place) AS k FROM l WHERE trim(line, ' ') <> '' GROUP BY line
), g AS (SELECT * FROM f WHERE n >= 16), c AS (
  SELECT a.line AS x, b.line AS y, a.n AS xn, b.n AS yn, a.k AS xk, b.k AS yk,
         coalesce(list_position(list_transform(range(1, a.n + 1), lambda i: substring(a.line, i, 1) <> substring(b.line, i, 1)), true) - 1, a.n) AS p
  FROM (SELECT a.*, b.line AS y FROM g a JOIN g b ON a.n = b.n AND a.k < b.k AND levenshtein(a.line, b.line) <= 4
        UNION ALL SELECT a.*, b.line FROM g a JOIN g b ON a.n + 1 = b.n AND levenshtein(a.line, b.line) <= 4) a JOIN g b ON a.y = b.line
), near AS (
  SELECT DISTINCT CASE WHEN xk < yk THEN y ELSE x END AS line FROM c
  WHERE substring(x, p + 1 + (CASE WHEN xn = yn THEN 1 ELSE 0 END)) = substring(y, p + 2)
), d AS (
  SELECT l.*, f.line IS NOT NULL AND (f.k <> doc_id * 1000000000 + place OR l.line IN (SELECT line FROM near)) AS dropped FROM l LEFT JOIN f ON l.line = f.line
), r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (dropped), '') AS dropped_lines,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text
  FROM d GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines, r.text
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id
"""
